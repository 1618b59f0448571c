"""Symbol indexes and build graphs of many repositories: binary files to document rows, manifests, rebased paths,
and loads where a broken repository becomes a row of status and the others are kept."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.functions.text import once
from mnemoq.operators import graph
from mnemoq.sources import domain, store

# fixed values: numbers of the index format's symbol kinds that make or hold edges; other kinds count as unknown
KINDS = {7: "Class", 9: "Constructor", 11: "Enum", 17: "Function", 21: "Interface", 25: "Macro", 26: "Method", 29: "Module", 30: "Namespace", 35: "Package",
         42: "Protocol", 49: "Struct", 53: "Trait", 54: "Type", 55: "TypeAlias", 66: "AbstractMethod", 80: "StaticMethod"}
SYMBOL = "struct<symbol:string, display_name:string, kind:string, signature:string, relationships:array<struct<symbol:string, is_implementation:boolean, is_reference:boolean>>>"
SCHEMA = f"part string, doc long, relative_path string, symbols array<{SYMBOL}>, occurrences array<struct<symbol:string, range:array<int>, symbol_roles:int>>, error string"
_RELATED = pa.struct([("symbol", pa.string()), ("is_implementation", pa.bool_()), ("is_reference", pa.bool_())])
_SYMBOL = pa.struct([("symbol", pa.string()), ("display_name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("relationships", pa.list_(_RELATED))])
_ARROW = pa.schema([("part", pa.string()), ("doc", pa.int64()), ("relative_path", pa.string()), ("symbols", pa.list_(_SYMBOL)),
                    ("occurrences", pa.list_(pa.struct([("symbol", pa.string()), ("range", pa.list_(pa.int32())), ("symbol_roles", pa.int32())]))), ("error", pa.string())])


# ---- the wire format -----------------------------------------------------------------------------
def _varint(b: memoryview, at: int, end: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= end or shift > 63:
            raise ValueError("number cut off or too long")
        byte, at = b[at], at + 1
        out |= (byte & 127) << shift
        if byte < 128:
            return out, at
        shift += 7


def _fields(b: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: a number, or the bytes of a text, a list or a message."""
    at, end = 0, len(b)
    while at < end:
        tag, at = _varint(b, at, end)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(b, at, end)
        else:
            size, at = _varint(b, at, end) if wire == 2 else ({1: 8, 5: 4}.get(wire, -1), at)
            if size < 0 or at + size > end or tag < 8:
                raise ValueError("not a field, or cut off")
            value, at = b[at:at + size], at + size
        yield tag >> 3, value


def _text(value) -> str:
    if isinstance(value, int):
        raise ValueError("a number where text is due")
    return bytes(value).decode()


def _numbers(value) -> list[int]:
    """A list of numbers, packed or one a field, as signed 32 bits."""
    out, at = [value] if isinstance(value, int) else [], 0
    while not isinstance(value, int) and at < len(value):
        n, at = _varint(value, at, len(value))
        out.append(n)
    return [((n & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000 for n in out]


def _message(value) -> Iterator[tuple[int, int | memoryview]]:
    if isinstance(value, int):
        raise ValueError("a number where a message is due")
    return _fields(value)


def _symbol(value) -> dict:
    out = {"symbol": "", "display_name": "", "kind": None, "signature": None, "relationships": []}
    for number, v in _message(value):
        if number == 1:
            out["symbol"] = _text(v)
        elif number == 4:
            r = {"symbol": "", "is_implementation": False, "is_reference": False}
            for n, w in _message(v):
                if n == 1:
                    r["symbol"] = _text(w)
                elif n in (2, 3):
                    r["is_reference" if n == 2 else "is_implementation"] = bool(w)
            out["relationships"].append(r)
        elif number == 5:
            out["kind"] = KINDS.get(v)
        elif number == 6:
            out["display_name"] = _text(v)
        elif number == 7:
            out["signature"] = next((_text(w) for n, w in _message(v) if n == 5 and len(w)), out["signature"])
    return out


def _occurrence(value) -> dict:
    out = {"symbol": "", "range": [], "symbol_roles": 0}
    for number, v in _message(value):
        if number == 1:
            out["range"] += _numbers(v)
        elif number == 2:
            out["symbol"] = _text(v)
        elif number == 3:
            out["symbol_roles"] = _numbers(v)[0]
    return out


def _documents(part: str, content: bytes) -> Iterator[dict]:
    """A file's documents in order, then each external symbol as a row without a path. A symbol without a name is none."""
    doc = -1
    for number, value in _fields(memoryview(content)):
        if number not in (2, 3):
            continue
        doc += 1
        row = {"part": part, "doc": doc, "relative_path": None, "symbols": [], "occurrences": [], "error": None}
        if number == 3:
            row["symbols"] = [_symbol(value)]
        else:
            row["relative_path"] = ""
            for n, v in _message(value):
                if n == 1:
                    row["relative_path"] = _text(v)
                elif n == 2:
                    row["occurrences"].append(_occurrence(v))
                elif n == 3:
                    row["symbols"].append(_symbol(v))
        row["symbols"] = [s | {"relationships": [r for r in s["relationships"] if r["symbol"]]} for s in row["symbols"] if s["symbol"]]
        row["occurrences"] = [o for o in row["occurrences"] if o["symbol"]]
        yield row


def decode(files: DataFrame, rows: int = 256) -> DataFrame:
    """One row a document, and one for each external symbol (its path is null), of files (part, content), as
    ``spark.read.format("binaryFile")`` gives them. A file is read once to check it and once to give rows, so that memory
    follows a file's bytes and one batch of rows. A file that can't be read gives one row, with its error, and no other; a
    null or empty file is an index without documents and gives none. Write the rows (``store.written``) before they are loaded,
    as loading looks at them several times."""

    def work(batches):
        for batch in batches:
            for part, content in zip(batch["part"].to_pylist(), batch["content"]):
                content, held = content.as_py() or b"", []
                try:
                    for _ in _documents(part, content):
                        pass
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"part": part, "error": str(e)[:200]}], _ARROW)
                    continue
                for row in _documents(part, content):
                    held.append(row)
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)

    return files.select(F.col("part").cast("string").alias("part"), "content").mapInArrow(work, SCHEMA)


# ---- several indexes -----------------------------------------------------------------------------
def rebase(path: Column, prefix: Column) -> Column:
    """A path below a module's folder, with that folder in front unless it is there; an empty or null folder changes nothing."""
    p = F.regexp_replace(F.coalesce(prefix, F.lit("")), r"/+$", "")
    return F.when((p == "") | (path == p) | F.startswith(path, F.concat(p, F.lit("/"))), path).otherwise(F.concat(p, F.lit("/"), path))


def manifest(lines: DataFrame) -> DataFrame:
    """(line, root, path, error) of a manifest's lines (line, value): a folder, a tab, an index file. Blank lines and comments
    are none; '.' is the empty folder; a line without tab or file has an error."""
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    at = F.instr(text, "\t")
    root, path = F.trim(F.substring_index(text, "\t", 1)), F.trim(F.expr("substring(_t, instr(_t, '\t') + 1)"))
    bad = F.when(at == 0, "no tab").when(path == "", "no file")
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#"))).withColumn("_t", text)
    return rows.select("line", F.when(bad.isNull(), F.when(root == ".", "").otherwise(root)).alias("root"), F.when(bad.isNull(), path).alias("path"), bad.alias("error"))


def merge(decoded: DataFrame, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, externals, status) of several decoded indexes as one. With roots (part, root) paths are rebased first.
    Parts are in the order of their names. Status has one row a part that gave rows: its documents, or its error; files
    without documents give none."""
    docs = decoded
    if roots is not None:
        docs = decoded.join(roots.select("part", "root"), "part", "left").withColumn("relative_path", rebase(F.col("relative_path"), F.col("root"))).drop("root")
    status = decoded.groupBy("part").agg(F.count("relative_path").alias("documents"), F.max("error").alias("error"))
    good = docs.where("error is null").drop("error")
    ext = good.where("relative_path is null").select("part", "doc", F.explode("symbols").alias("s")).select("part", "doc", "s.symbol", "s.kind")
    return good.where("relative_path is not null"), ext, status


# ---- build graphs and modules --------------------------------------------------------------------
RULE = "type string, rule struct<name:string, ruleClass:string, location:string, ruleInput:array<string>>, _bad string"


def build_graph(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, status) of build graphs printed as JSON, a line an entry (project, value). Entries that aren't rules are
    passed over. A project with a line that isn't JSON, or with a rule without a name, loads nothing: status has its error."""
    rows = lines.where(F.trim("value") != "").select("project", F.from_json("value", RULE, {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    is_rule = F.col("e.type") == "RULE"
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | F.coalesce(is_rule & F.col("e.rule").isNotNull() & F.col("e.rule.name").isNull(), F.lit(False))
    rows = rows.withColumn("bad", bad)
    status = rows.groupBy("project").agg(F.count_if(is_rule & F.col("e.rule").isNotNull() & ~F.col("bad")).alias("rules"), F.count_if("bad").alias("broken_lines"))
    status = status.select("project", F.when(F.col("broken_lines") > 0, 0).otherwise(F.col("rules")).alias("rules"), "broken_lines", (F.col("broken_lines") == 0).alias("loaded"))
    rules = rows.where(is_rule & F.col("e.rule").isNotNull()).join(rows.where("bad").select("project").distinct(), "project", "left_anti")
    return rules.select("project", F.col("e.rule.name").alias("name"), F.coalesce("e.rule.ruleClass", F.lit("")).alias("rule_class"), F.coalesce("e.rule.location", F.lit("")).alias("location"), F.coalesce("e.rule.ruleInput", F.array().cast("array<string>")).alias("inputs")), status


def modules(paths: DataFrame) -> DataFrame:
    """(repo, module) of a listing (repo, path, is_link): folders with a go.mod, '' for the repository itself. What lies in a
    hidden, vendor or testdata folder, or below a link, isn't seen."""
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    seen = paths.where((F.element_at(parts, -1) == "go.mod") & ~F.coalesce("is_link", F.lit(False)) & ~F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | x.isin("vendor", "testdata")))
    found = seen.select("repo", F.array_join(folders, "/").alias("module"), folders.alias("_f")).distinct()
    above = found.select("repo", "module", F.posexplode("_f").alias("i", "_x"), "_f").select("repo", "module", F.array_join(F.slice("_f", F.lit(1), F.col("i") + 1), "/").alias("path"))
    linked = above.join(paths.where("is_link").select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "module").distinct()
    return found.drop("_f").join(linked, ["repo", "module"], "left_anti")


def label_count(text: Column) -> Column:
    """Lines with a label: those that aren't blank; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"(?U)\S")))).cast("long")


# ---- queries -------------------------------------------------------------------------------------
def _hex_varint(n: Column) -> Column:
    low, byte = lambda n, k: F.shiftright(n, 7 * k).bitwiseAND(127), lambda x: F.lpad(F.hex(x), 2, "0")
    more = lambda n, *ks: [byte(low(n, k).bitwiseOR(128)) for k in ks]
    return once(n, lambda n: F.when(n < 1 << 7, byte(n)).when(n < 1 << 14, F.concat(*more(n, 0), byte(low(n, 1)))).when(n < 1 << 21, F.concat(*more(n, 0, 1), byte(low(n, 2)))).otherwise(F.concat(*more(n, 0, 1, 2), byte(low(n, 3)))))


def _hex_field(number: int, payload: Column) -> Column:
    return once(payload, lambda p: F.concat(F.lit(f"{number << 3 | 2:02X}"), _hex_varint(F.shiftright(F.length(p), 1)), p))


def _hex_text(number: int, text: Column) -> Column:
    return _hex_field(number, F.hex(F.encode(text, "UTF-8")))


def _hex_number(number: int, n: Column) -> Column:
    return F.concat(F.lit(f"{number << 3:02X}"), _hex_varint(n))


def _files(s: SparkSession, d: str) -> DataFrame:
    """Customers as symbols in index files of 100, in documents of 50: each is a function that is defined on one line and uses a
    library's symbol on the next. Every tenth file lacks its last byte."""
    c = domain.read(s, d, "customer").withColumns({"part": F.expr("c_custkey div 100"), "d": F.expr("c_custkey div 50"), "line": (F.col("c_custkey") % 50 * 2).cast("int")})
    own, lib = F.concat(F.lit("x pkg own 1 c"), "c_custkey", F.lit("().")), F.concat(F.lit("x pkg lib 2 f"), F.col("c_custkey") * 7 % 1000, F.lit("()."))
    span = lambda n: _hex_field(1, F.concat(_hex_varint(n), F.lit("0003")))
    sym = _hex_field(3, F.concat(_hex_text(1, own), _hex_number(5, F.lit(17)), _hex_text(6, F.col("c_name")), _hex_field(7, _hex_text(5, F.col("c_mktsegment")))))
    uses = F.concat(_hex_field(2, F.concat(span(F.col("line")), _hex_text(2, own), _hex_number(3, F.lit(1)))), _hex_field(2, F.concat(span(F.col("line") + 1), _hex_text(2, lib))))
    ext = _hex_field(3, F.concat(_hex_text(1, lib), _hex_number(5, F.when(F.col("c_custkey") * 7 % 2 == 0, 49).otherwise(17))))
    per = c.groupBy("part", "d").agg(F.array_join(F.collect_list(F.concat(sym, uses)), "").alias("body"), F.array_join(F.collect_list(ext), "").alias("ext"))
    path = F.when(F.col("part") % 2 == 0, F.concat(F.lit("mod"), "part", F.lit("/f"), "d")).otherwise(F.concat(F.lit("f"), "d"))
    one = per.groupBy("part").agg(F.concat(F.array_join(F.collect_list(_hex_field(2, F.concat(_hex_text(1, path), F.col("body")))), ""), F.array_join(F.collect_list("ext"), "")).alias("h"))
    cut = F.when(F.col("part") % 10 == 3, F.expr("substring(h, 1, length(h) - 2)")).otherwise(F.col("h"))
    return one.select(F.col("part").cast("string").alias("part"), F.unhex(cut).alias("content"))


def _merged(s: SparkSession, d: str):
    files = _files(s, d)
    return merge(store.written(decode(files), "symbol-index"), files.select("part", F.concat(F.lit("mod"), "part").alias("root")))


def _a15(s: SparkSession, d: str, edges: bool) -> DataFrame:
    docs, ext, _ = _merged(s, d)
    ent, rel = graph.load(docs, "/many", ext)
    return rel.select("src", "dst", "kind") if edges else ent.select("id", "name", "project", "file_path", "line_range", "signature")


def _graph_lines(s: SparkSession, d: str) -> DataFrame:
    """Orders as a build graph's lines: some are source files, a few of some projects are cut off."""
    name = F.concat(F.lit("//o:"), "o_orderkey")
    entry = F.to_json(F.struct(F.when(F.col("o_orderkey") % 5 == 0, "SOURCE_FILE").otherwise("RULE").alias("type"), F.struct(
        name.alias("name"), F.lit("lib").alias("ruleClass"), F.concat(F.lit("/w/p/BUILD:"), F.col("o_custkey"), F.lit(":1")).alias("location"), F.array(F.concat(F.lit("//o:"), F.col("o_orderkey") + 1), name).alias("ruleInput")).alias("rule")))
    broken = (F.col("o_custkey") % 20 == 4) & (F.col("o_orderkey") % 97 == 1)
    return domain.read(s, d, "orders").select(F.concat(F.lit("/w"), F.col("o_custkey") % 20).alias("project"), F.when(broken, F.substring(entry, 1, 20)).otherwise(entry).alias("value"))


def _listing(s: SparkSession, d: str) -> DataFrame:
    seg = F.expr("array_compact(array(concat('m', p_partkey), if(p_partkey % 7 = 0, 'vendor', null), if(p_partkey % 11 = 0, '.git', null), if(p_partkey % 13 = 0, 'testdata', null), if(p_partkey % 3 = 0, 'sub', null)))")
    p = domain.read(s, d, "part").withColumns({"repo": F.col("p_brand"), "seg": seg})
    files = p.select("repo", F.concat(F.array_join("seg", "/"), F.lit("/"), F.when(F.col("p_size") % 2 == 0, "go.mod").otherwise("main.go")).alias("path"), F.lit(False).alias("is_link"))
    return files.unionByName(p.where("p_partkey % 17 = 0").select("repo", F.concat(F.lit("m"), "p_partkey").alias("path"), F.lit(True).alias("is_link")))


def _manifest_lines(s: SparkSession, d: str) -> DataFrame:
    return domain.read(s, d, "supplier").selectExpr("s_suppkey as line", "case s_suppkey % 6 when 0 then '  ' when 1 then concat('# ', s_name) when 2 then concat(s_name, '.index') when 3 then concat('.\t', s_name, '.index ') when 4 then concat('mod', s_nationkey, ' \t ', s_name) else concat(s_name, '\t') end as value")


QUERIES = {
    "a15_symbol_entities": lambda s, d: _a15(s, d, False), "a15_symbol_edges": lambda s, d: _a15(s, d, True), "a16_merge_status": lambda s, d: _merged(s, d)[2].selectExpr("part", "documents", "error is null as loaded"),
    "a18_manifest": lambda s, d: manifest(_manifest_lines(s, d)), "a19_build_graph": lambda s, d: build_graph(_graph_lines(s, d))[0].selectExpr("project", "name", "size(inputs) as n_inputs"),
    "a27_load_status": lambda s, d: build_graph(_graph_lines(s, d))[1], "a30_modules": lambda s, d: modules(_listing(s, d)),
    "a31_label_counts": lambda s, d: domain.read(s, d, "documents").select("doc_id", label_count(F.col("text")).alias("n")),
    "f15_build_targets": lambda s, d: graph.target_rows(build_graph(_graph_lines(s, d))[0], "/w/p"),
}

_GOOD = "WITH c AS (SELECT *, c_custkey // 100 AS part, c_custkey // 50 AS d, c_custkey % 50 * 2 AS line, c_custkey * 7 % 1000 AS lib FROM customer), g AS (SELECT * FROM c WHERE part % 10 <> 3)"
_LINES = "WITH l AS (SELECT '/w' || (o_custkey % 20) AS project, *, o_custkey % 20 = 4 AND o_orderkey % 97 = 1 AS bad, o_orderkey % 5 <> 0 AS is_rule FROM orders), ok AS (SELECT project FROM l GROUP BY 1 HAVING NOT bool_or(bad)), r AS (SELECT * FROM l JOIN ok USING (project) WHERE is_rule)"
ORACLES = {
    "a15_symbol_entities": f"{_GOOD} SELECT 'x pkg own 1 c' || c_custkey || '().' AS id, c_name AS name, '/many' AS project, 'mod' || part || '/f' || d AS file_path, (line + 1) || ':' || (line + 1) AS line_range, c_mktsegment AS signature FROM g UNION ALL SELECT DISTINCT 'x pkg lib 2 f' || lib || '().', 'f' || lib, '/many', NULL, NULL, NULL FROM g",
    # an external symbol's kind (struct) comes before its suffix; which of several externals is first does not matter here
    "a15_symbol_edges": f"{_GOOD} SELECT 'x pkg own 1 c' || c_custkey || '().' AS src, 'x pkg lib 2 f' || lib || '().' AS dst, CASE WHEN lib % 2 = 0 THEN 'REFERENCES' ELSE 'CALLS' END AS kind FROM g",
    "a16_merge_status": f"{_GOOD} SELECT part::VARCHAR AS part, CASE WHEN part % 10 <> 3 THEN count(DISTINCT d) ELSE 0 END AS documents, part % 10 <> 3 AS loaded FROM c GROUP BY part",
    "a18_manifest": "SELECT s_suppkey AS line, CASE s_suppkey % 6 WHEN 3 THEN '' WHEN 4 THEN 'mod' || s_nationkey END AS root, CASE s_suppkey % 6 WHEN 3 THEN s_name || '.index' WHEN 4 THEN s_name END AS path, CASE WHEN s_suppkey % 6 IN (2, 5) THEN 'no tab' END AS error FROM supplier WHERE s_suppkey % 6 > 1",
    "a19_build_graph": f"{_LINES} SELECT project, '//o:' || o_orderkey AS name, 2::INT AS n_inputs FROM r",
    "a27_load_status": f"{_LINES} SELECT project, CASE WHEN bool_or(bad) THEN 0 ELSE count(*) FILTER (is_rule) END::BIGINT AS rules, count(*) FILTER (bad) AS broken_lines, NOT bool_or(bad) AS loaded FROM l GROUP BY 1",
    "a30_modules": "SELECT DISTINCT p_brand AS repo, 'm' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '/sub' ELSE '' END AS module FROM part WHERE p_size % 2 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0",
    "a31_label_counts": r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS n FROM documents",
    "f15_build_targets": f"{_LINES} SELECT '//o:' || o_orderkey AS id, 'bazel_target' AS kind, o_orderkey::VARCHAR AS name, project, 'BUILD' AS file_path, o_custkey || ':' || o_custkey AS line_range FROM r",
}
