"""Neighbourhoods of many symbols at once as Markdown with a byte cap, contexts of read files, and the reads they spare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoq.functions.text import n_tokens
from mnemoq.operators.graph import current
from mnemoq.sources import domain, store
from mnemoq.sources.domain import duck

# fixed values: limits, titles and marks of the rendered text
MATCHES, NODES, SIBLINGS, IN_FILE, CAP, CONTEXT_CAP = 8, 30, 10, 30, 8192, 2048
TITLES = (("CALLS", "**Calls**: "), (None, "**References**: "), ("BAZEL_DEPENDS_ON", "**Bazel deps**: "))
CALLED_BY, SAME_FILE, IMPORTS = "**Called by**: ", "**Sibling symbols** (same file): ", "**Imports**: "
CUT, CONTEXT_CUT = "\n…[truncated]\n", "\n…[truncated]"
CONTEXT = "This file's symbols are indexed; ask for a symbol's neighbourhood to see its callers, callees and siblings.\n\nIndexed symbols in {}:\n"
BITS = 1 << 24  # 2 MB: of a million keys it lets 6 % of other rows through
_PLACE = ("project", "file_path", "line_range")


# ---- text with a byte cap ------------------------------------------------------------------------
def cut_bytes(text: Column, most: Column) -> Column:
    """The longest beginning of a text with at most so many bytes in UTF-8, by whole characters."""
    b = F.encode(text, "UTF-8")
    inside = lambda end: F.substring(F.hex(F.substring(b, end + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    end = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).when(most <= 0, "").otherwise(F.decode(F.substring(b, F.lit(1), end), "UTF-8"))


def capped(parts: Column, cap: int) -> Column:
    """Parts one after the other (null ones aside) up to the cap; the one that goes over it is cut and marked, and nothing follows."""

    def push(out: Column, part: Column) -> Column:
        room = F.lit(cap) - F.octet_length(out)
        return F.when(room <= 0, out).when(F.octet_length(part) <= room, F.concat(out, part)).otherwise(F.concat(out, cut_bytes(part, room), F.lit(CUT)))

    return F.aggregate(F.array_compact(parts), F.lit(""), push)


def place(e, home: Column | None = None) -> Column:
    """Where an entity lies, 'file:first line'; with the last part of its project in front where that isn't ``home``. Without a file null."""
    first = F.substring_index(e["line_range"], ":", 1)
    at = F.when(F.coalesce(first, F.lit("")) != "", F.concat(e["file_path"], F.lit(":"), first)).otherwise(e["file_path"])
    if home is None:
        return at
    base = F.regexp_extract(e["project"], r"([^/]+)/*$", 1)
    return F.when(home != e["project"], F.concat(F.lit("repo:"), F.when(base == "", e["project"]).otherwise(base), F.lit(" :: "), at)).otherwise(at)


# ---- neighbourhoods ------------------------------------------------------------------------------
def _first(rows: DataFrame, by, order: list, most: int) -> DataFrame:
    """The first rows of each key with their rank; the limit holds in the tasks ahead of the shuffle, too, so a hot key is short there."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def likely(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose column may be among keys (a column ``id``): all that are, and few others. What is sent to the tasks is
    a bitmap of hashes, BITS long at most, so rows that no join would keep aren't shuffled for it; the join still has to follow."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = keys.select(at("id").alias("_at")).groupBy(F.expr("_at div 32768").alias("_block")).agg(F.bitmap_construct_agg(F.col("_at") % 32768).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(_at % 32768 div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_at", at(column)).withColumn("_block", F.expr("_at div 32768")).join(F.broadcast(bits), "_block")
    return held.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).select(*rows.columns)


def resolved(symbols: DataFrame, entities: DataFrame) -> DataFrame:
    """(symbol, rank, n, id, name, ..): the entities with a symbol's id, then those with its name, eight at most; n is how many."""
    q = symbols.select("symbol").where("symbol is not null").distinct()
    asked = q.select(F.col("symbol").alias("id"))
    e = entities.select("id", "name", *_PLACE, "signature")
    by_id = likely(e, "id", asked).withColumns({"symbol": F.col("id"), "_by": F.lit(0)})
    # of a name that very many share, eight go into the join
    by_name = _first(likely(e.where("id <> name"), "name", asked), "name", ["id"], MATCHES).drop("rank").withColumns({"symbol": F.col("name"), "_by": F.lit(1)})
    both = q.join(by_id, "symbol").unionByName(q.join(by_name, "symbol"))
    return _first(both, "symbol", ["_by", "id"], MATCHES).drop("_by").withColumn("n", F.count("*").over(W.partitionBy("symbol")))


def neighbours(found: DataFrame, relations: DataFrame, entities: DataFrame, nodes: int = NODES) -> DataFrame:
    """(symbol, direction, rank, kind, other, name, ..) of symbols with one entity: outgoing edges up to half of nodes, and
    incoming ones up to what those leave. Edges go through two shuffles, with ids and names alone; places come to what is left."""
    r, names, asked = current(relations), entities.select(F.col("id").alias("other"), "name"), found.select("symbol", "id")

    def way(here: str, there: str, most: int, name: str) -> DataFrame:
        ends = r.select(F.col(here).alias("id"), F.col(there).alias("other"), "kind", F.col("id").alias("edge"))
        # a symbol has one entity here, so an entity's ranks are those of its symbols
        first = _first(likely(ends, "id", asked).join(names, "other"), "id", ["kind", "name", "edge"], most)
        return asked.join(first, "id").withColumn("direction", F.lit(name))

    both = way("src", "dst", max(nodes // 2, 1), "out").unionByName(way("dst", "src", max(nodes, 1), "in"))
    out = F.count_if(F.col("direction") == "out").over(W.partitionBy("symbol"))  # nodes * 3 / 2 rows a symbol at most
    both = both.withColumn("_out", out).where((F.col("direction") == "out") | (F.col("rank") <= F.greatest(F.lit(nodes) - F.col("_out"), F.lit(1)))).drop("_out", "id", "edge")
    return both.join(entities.select(F.col("id").alias("other"), *_PLACE), "other")


def markdown(symbols: DataFrame, relations: DataFrame, entities: DataFrame, nodes: int = NODES, cap: int = CAP) -> DataFrame:
    """(symbol, n, markdown): a symbol with no entity says so, one with several lists them, one with one shows its edges by kind
    and the symbols of its file. An edge to the same entity shows once a kind; entities without a name are left out. Each
    symbol's text is made from a bounded number of rows, with column functions."""
    found = store.written(resolved(symbols, entities), "found")
    head = F.struct("rank", "id", "name", *_PLACE, "signature")
    heads = found.groupBy("symbol").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(head)).alias("m"))
    one = found.where("n = 1")
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    edge = F.struct("rank", "kind", "name", *_PLACE)
    edges = neighbours(one, relations, entities, nodes).where(named).groupBy("symbol", "direction", F.when(F.col("direction") == "out", F.col("kind")).alias("_k"), "other").agg(F.min(edge).alias("e"))
    edges = edges.groupBy("symbol").agg(*[F.array_sort(F.collect_list(F.when(F.col("direction") == w, F.col("e")))).alias(a) for a, w in (("_o", "out"), ("_i", "in"))])
    # the first of a file, and one more for the symbol itself, are found once a file: all its symbols are among its entities' neighbours
    beside = _first(entities.where("file_path is not null").select("id", "name", "file_path", "line_range"), "file_path", [F.col("line_range").asc_nulls_first(), "id"], SIBLINGS + 1)
    near = one.select("symbol", F.col("id").alias("_id"), "file_path").join(beside.withColumnRenamed("rank", "_r"), "file_path").where("id <> _id")
    near = _first(near, "symbol", ["_r"], SIBLINGS).where(named).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("_s"))
    all_ = symbols.select("symbol").where("symbol is not null").distinct().join(heads, "symbol", "left").join(edges, "symbol", "left").join(near, "symbol", "left")

    h, tick = F.col("m")[0], lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    shown = lambda x: F.concat(tick(x["name"]), F.coalesce(F.concat(F.lit(" ("), F.nullif(place(x, h["project"]), F.lit("")), F.lit(")")), F.lit("")))

    def section(title: str, items: Column, each) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(F.transform(items, each), ", "), F.lit("\n")))

    kinds = [k for k, _ in TITLES if k] + ["IMPORTS"]
    of = lambda kind: F.filter("_o", lambda x: x["kind"] == kind if kind else ~x["kind"].isin(kinds))
    card = F.array(
        F.concat(F.lit("## Symbol `"), h["name"], F.lit("` (defined in "), F.coalesce(place(h), F.lit("?")), F.lit(")\n")),
        F.when(h["signature"] != "", F.concat(F.lit("```\n"), h["signature"], F.lit("\n```\n"))),
        *[section(title, of(kind), shown) for kind, title in TITLES], section(CALLED_BY, F.col("_i"), shown),
        section(SAME_FILE, F.col("_s"), lambda x: tick(x["name"])), section(IMPORTS, of("IMPORTS"), lambda x: tick(x["name"])))
    several = F.concat(F.array(F.lit("## Multiple matches\n")), F.transform("m", lambda x: F.concat(F.lit("- "), tick(x["name"]), F.lit(" ("), F.coalesce(place(x), F.lit("?")), F.lit(")\n"))))
    n = F.coalesce("n", F.lit(0))
    return all_.select("symbol", n.alias("n"), F.when(n == 0, "No symbols matched.\n").when(n > 1, capped(several, cap)).otherwise(capped(card, cap)).alias("markdown"))


# ---- files ---------------------------------------------------------------------------------------
def entities_in(paths: DataFrame, entities: DataFrame, most: int = IN_FILE) -> DataFrame:
    """(path, rank, id, name, line_range, signature) of the entities of files, by line range as text."""
    e = entities.select(F.col("file_path").alias("path"), "id", "name", "line_range", "signature")
    return _first(paths.select("path").distinct().join(e, "path"), "path", [F.col("line_range").asc_nulls_first(), "id"], most)


def read_context(paths: DataFrame, entities: DataFrame, cap: int = CONTEXT_CAP) -> DataFrame:
    """(path, context): what is indexed of a file that was read, cut to the cap with its mark; files with nothing give no row."""
    per = entities_in(paths, entities).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "line_range", "signature"))).alias("m"))
    line = lambda x: F.concat(F.lit("- `"), F.coalesce(x["name"], F.lit("")), F.lit("` @ "), F.coalesce(x["line_range"], F.lit("?")), F.when(x["signature"] != "", F.concat(F.lit(" — `"), x["signature"], F.lit("`"))).otherwise(""), F.lit("\n"))
    before, after = CONTEXT.split("{}")
    whole = F.concat(F.lit(before), "path", F.lit(after), F.array_join(F.transform("m", line), ""))
    mark = len(CONTEXT_CUT.encode())
    rows = per.select("path", whole.alias("context"))
    return rows.select("path", F.when(F.octet_length("context") <= cap, F.col("context")).otherwise(F.concat(cut_bytes(F.col("context"), F.lit(max(cap - mark, 0))), F.lit(CONTEXT_CUT))).alias("context"))


def avoided_reads(symbols: DataFrame, entities: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """(symbol, tokens): the tokens of the file (project, path, text) that defines a symbol with one entity, of ``root``'s copy if
    it has one; else 0. Only files that are asked for are counted."""
    found = resolved(symbols, entities).where("n = 1 and project is not null and file_path is not null").select("symbol", "project", F.col("file_path").alias("path"))
    wanted = found.select("project", "path")
    if root is not None:
        wanted = wanted.unionByName(found.select(F.lit(root).alias("project"), "path"))
    size = files.join(wanted.distinct(), ["project", "path"], "left_semi").select("project", "path", n_tokens(F.col("text")).alias("_n"))
    out = found.join(size, ["project", "path"], "left")
    if root is not None:
        out = out.join(size.where(F.col("project") == root).select("path", F.col("_n").alias("_r")), "path", "left").withColumn("_n", F.coalesce("_r", "_n"))
    return symbols.select("symbol").where("symbol is not null").distinct().join(out.select("symbol", "_n"), "symbol", "left").select("symbol", F.coalesce("_n", F.lit(0)).alias("tokens"))


# ---- queries -------------------------------------------------------------------------------------
def _asked(s: SparkSession, d: str) -> DataFrame:
    """Names of all parts (some are shared), suppliers and regions (none is an entity), and nations by id."""
    return domain.read(s, d, "part").selectExpr("p_name as symbol").union(domain.read(s, d, "supplier").selectExpr("s_name")).union(domain.read(s, d, "region").selectExpr("r_name")).union(domain.read(s, d, "nation").selectExpr("concat('n:', n_nationkey)"))


def _markdown(s: SparkSession, d: str, cap: int = CAP) -> DataFrame:
    return markdown(_asked(s, d), domain.relations(s, d), domain.entities(s, d), cap=cap)


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Documents as the files of the entities: brands' and nations' names are paths."""
    return domain.read(s, d, "documents").selectExpr("concat('/p', doc_id % 3) as project", "if(doc_id % 2 = 0, concat('Brand#', doc_id), concat('n', doc_id)) as path", "text").where("text is not null")


QUERIES = {
    "f17_resolve_all": lambda s, d: resolved(_asked(s, d), domain.entities(s, d)).select("symbol", "rank", "n", "id"),
    "f18_neighbours_all": lambda s, d: neighbours(resolved(_asked(s, d), domain.entities(s, d)).where("n = 1"), domain.relations(s, d), domain.entities(s, d)).select("symbol", "direction", "rank", "kind", "other"),
    "f20_entities_in_file": lambda s, d: entities_in(domain.entities(s, d).selectExpr("file_path as path"), domain.entities(s, d)).select("path", "rank", "id"),
    "f21_markdown": _markdown, "f21_markdown_short": lambda s, d: _markdown(s, d, 256),
    "f23_avoided_reads": lambda s, d: avoided_reads(_asked(s, d), domain.entities(s, d), _sources(s, d), "/p0"),
    "f24_read_context": lambda s, d: read_context(domain.entities(s, d).selectExpr("file_path as path"), domain.entities(s, d)),
}

_CTE = f"""{duck('relations', 'entities')}, q AS (SELECT DISTINCT * FROM (SELECT p_name AS symbol FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT r_name FROM region UNION ALL SELECT 'n:' || n_nationkey FROM nation)),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol)::BIGINT AS n FROM (SELECT symbol, e.*, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN e.id = symbol THEN 0 ELSE 1 END, e.id)::INT AS rank FROM q JOIN entities e ON e.id = symbol OR e.name = symbol) WHERE rank <= {MATCHES})"""
_WAY = "SELECT *, '{2}' AS direction FROM (SELECT f.symbol, f.project AS home, r.kind, r.{1} AS other, e.name, e.project, e.file_path, e.line_range, row_number() OVER (PARTITION BY f.symbol ORDER BY r.kind, e.name, r.id)::INT AS rank FROM f JOIN relations r ON r.{0} = f.id JOIN entities e ON e.id = r.{1} WHERE f.n = 1 AND NOT closed) WHERE rank <= {3}"
_NEAR = f"{_CTE}, o AS ({_WAY.format('src', 'dst', 'out', NODES // 2)}), c AS (SELECT symbol, count(*) AS k FROM o GROUP BY 1), i AS (SELECT w.* FROM ({_WAY.format('dst', 'src', 'in', NODES)}) w LEFT JOIN c USING (symbol) WHERE rank <= greatest({NODES} - coalesce(k, 0), 1))"
_SHOWN = "string_agg('`' || name || '` (' || CASE WHEN project <> home THEN 'repo:' || replace(project, '/', '') || ' :: ' ELSE '' END || file_path || ':' || split_part(line_range, ':', 1) || ')', ', ' ORDER BY rank)"
_CARDS = f"""{_NEAR}, od AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY symbol, kind, other ORDER BY rank) = 1), id AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY symbol, other ORDER BY rank) = 1),
s AS (SELECT symbol, string_agg('`' || name || '`', ', ' ORDER BY rank) AS t FROM (SELECT symbol, e.name, row_number() OVER (PARTITION BY symbol ORDER BY e.line_range NULLS FIRST, e.id) AS rank FROM f JOIN entities e ON e.file_path = f.file_path AND e.id <> f.id WHERE n = 1) WHERE rank <= {SIBLINGS} GROUP BY 1),
oo AS (SELECT symbol, CASE WHEN kind IN ('CALLS', 'IMPORTS') THEN kind ELSE 'REFERENCES' END AS g, {_SHOWN} AS t, string_agg('`' || name || '`', ', ' ORDER BY rank) AS names FROM od GROUP BY 1, 2), ii AS (SELECT symbol, {_SHOWN} AS t FROM id GROUP BY 1),
parts AS (SELECT f.symbol, f.n, ['## Symbol `' || f.name || '` (defined in ' || file_path || ':' || split_part(line_range, ':', 1) || ')' || chr(10), '```' || chr(10) || signature || chr(10) || '```' || chr(10), '**Calls**: ' || a.t || chr(10), '**References**: ' || b.t || chr(10), '**Called by**: ' || ii.t || chr(10), '**Sibling symbols** (same file): ' || s.t || chr(10), '**Imports**: ' || m.names || chr(10)] AS l
FROM f LEFT JOIN oo a ON a.symbol = f.symbol AND a.g = 'CALLS' LEFT JOIN oo b ON b.symbol = f.symbol AND b.g = 'REFERENCES' LEFT JOIN oo m ON m.symbol = f.symbol AND m.g = 'IMPORTS' LEFT JOIN ii ON ii.symbol = f.symbol LEFT JOIN s ON s.symbol = f.symbol WHERE f.n = 1
UNION ALL SELECT symbol, n, ['## Multiple matches' || chr(10)] || list('- `' || name || '` (' || file_path || ':' || split_part(line_range, ':', 1) || ')' || chr(10) ORDER BY rank) FROM f WHERE n > 1 GROUP BY 1, 2
UNION ALL SELECT symbol, 0, ['No symbols matched.' || chr(10)] FROM q WHERE symbol NOT IN (SELECT symbol FROM f)), p AS (SELECT symbol, n, list_filter(l, lambda x: x IS NOT NULL) AS l FROM parts)"""
_FIT = "{0} SELECT symbol, n, CASE WHEN length(t) <= {1} THEN t WHEN list_contains(list_transform(range(1, len(l) + 1), lambda i: length(array_to_string(l[1:i], ''))), {1}) THEN t[1:{1}] ELSE t[1:{1}] || chr(10) || '…[truncated]' || chr(10) END AS markdown FROM (SELECT *, array_to_string(l, '') AS t FROM p)"
ORACLES = {
    "f17_resolve_all": f"{_CTE} SELECT symbol, rank, n, id FROM f",
    "f18_neighbours_all": f"{_NEAR} SELECT symbol, direction, rank, kind, other FROM o UNION ALL SELECT symbol, direction, rank, kind, other FROM i",
    "f20_entities_in_file": f"{duck('entities')} SELECT path, rank, id FROM (SELECT file_path AS path, id, row_number() OVER (PARTITION BY file_path ORDER BY line_range NULLS FIRST, id)::INT AS rank FROM entities) WHERE rank <= {IN_FILE}",
    "f21_markdown": _FIT.format(_CARDS, CAP), "f21_markdown_short": _FIT.format(_CARDS, 256),
    "f23_avoided_reads": rf"{_CTE}, d AS (SELECT '/p' || (doc_id % 3) AS project, CASE WHEN doc_id % 2 = 0 THEN 'Brand#' ELSE 'n' END || doc_id AS path, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')) AS k FROM documents WHERE text IS NOT NULL) SELECT q.symbol, coalesce(r.k, d.k, 0)::BIGINT AS tokens FROM q LEFT JOIN f ON f.symbol = q.symbol AND f.n = 1 LEFT JOIN d ON d.project = f.project AND d.path = f.file_path LEFT JOIN d r ON r.project = '/p0' AND r.path = f.file_path",
    "f24_read_context": f"{duck('entities')}, c AS (SELECT file_path AS path, '{CONTEXT.split('{}')[0].replace(chr(39), chr(39) * 2)}' || file_path || '{CONTEXT.split('{}')[1]}' || string_agg('- `' || name || '` @ ' || line_range || ' — `' || signature || '`' || chr(10), '' ORDER BY rank) AS t FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_range NULLS FIRST, id) AS rank FROM entities) WHERE rank <= {IN_FILE} GROUP BY file_path) SELECT path, CASE WHEN strlen(t) <= {CONTEXT_CAP} THEN t ELSE t[1:list_max(list_filter(range(1, {CONTEXT_CAP}), lambda i: strlen(t[1:i]) <= {CONTEXT_CAP} - 15))] || chr(10) || '…[truncated]' END AS context FROM c",
}
