"""URL filters: a trie over reversed host labels, then path segments, broadcast to the tasks; among
the entries that fit, the longest wins, between allow and block alike: the one with the most characters
in host and path together, and, of equally long ones, the one with the longer host.

A rule (host, path) fits its host and all subdomains, for url paths that start with the rule's. Rules
are a parameter of bounded size (``max_rules``), checked before they are broadcast; the urls stay
where they are, so nothing is shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the
default verdict. Very long urls are looked up whole. Repeated rows each get a result, an empty table none.
Of equal rules the last one given stands. Extra columns pass through ``judge``; host, path, rule and verdict
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


class Trie:
    """Nodes are dicts: host labels from the right, then, below the key "/", path segments; "" holds (path rest -> rule)."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            whole, _, rest = path.rpartition("/")
            node = node.setdefault("/", {})
            for segment in whole.split("/") if "/" in path else ():
                node = node.setdefault(segment, {})
            # what follows the last slash need not be a whole segment
            node.setdefault(None, {})[(rest, "/" in path)] = (f"{host}{path}", verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, (None, None) if none does: on the way down the host's labels each node gives its longest path."""
        node, best = self.root, self._path(self.root, path) or (None, None)
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            rule = self._path(node, path)
            if rule and (best[0] is None or len(rule[0]) >= len(best[0])):
                best = rule
        return best

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        node, best = node.get("/"), None
        segments = path.split("/")
        for k in range(len(segments)):
            if node is None:
                break
            for (rest, slash), rule in sorted(node.get(None, {}).items()):
                if slash == (k > 0) and segments[k].startswith(rest) or not slash and k == 0 and path.startswith(rest):
                    best = rule
            node = node.get(segments[k])
        return best


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", max_rules: int = 1_000_000) -> DataFrame:
    """urls (with a column ``url``) and host, path, rule (null if none fits), verdict. Columns of those names are replaced."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast")
    sent = urls.sparkSession.sparkContext.broadcast(Trie(rules))
    at = urls.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    schema = T.StructType([*at.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.find
        for b in batches:
            got = [find(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            cols = [*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([v or default for _, v in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "rule", "verdict"])

    return at.mapInArrow(look_up, schema)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, p, v)),
m AS (SELECT page_id, arg_max(h || p, 1000000 * length(h || p) + length(h)) AS rule, arg_max(v, 1000000 * length(h || p) + length(h)) AS v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
