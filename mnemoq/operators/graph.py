"""The code knowledge graph: loading symbol documents, edges, pruning, and neighbourhood queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoq.sources import domain
from mnemoq.sources.domain import duck

RELATION_KINDS = ("CALLS", "REFERENCES", "IMPORTS", "IMPLEMENTS", "EXTENDS", "DEFINES", "BAZEL_DEPENDS_ON")

# fixed values: symbol kinds that are called, kinds referred to as types, and how specific kinds are as enclosing definitions
CALLABLE = ("Function", "Method", "Constructor", "StaticMethod", "AbstractMethod", "Macro")
TYPES = ("Class", "Struct", "Interface", "Trait", "Enum", "TypeAlias", "Type", "Protocol")
HOLDERS = ("Class", "Struct", "Interface", "Trait", "Enum")
UNITS = ("Module", "Namespace", "Package")
IMPORT_ROLE = 2


# ---- loading -------------------------------------------------------------------------------------
def range_text(r: Column) -> Column:
    """A span of 3 or 4 numbers, from 0, as 'first:last' line, from 1."""
    first = F.when(F.size(r) >= 3, F.get(r, F.lit(0))).otherwise(0)
    last = F.when(F.size(r) == 4, F.get(r, F.lit(2))).when(F.size(r) == 3, F.get(r, F.lit(0))).otherwise(0)
    return F.concat((first + 1).cast("string"), F.lit(":"), (last + 1).cast("string"))


def suffix_kind(symbol: Column) -> Column:
    s = F.rtrim(symbol, F.lit("."))
    return F.when(F.startswith(symbol, F.lit("local ")), None).when(F.endswith(s, F.lit(")")), "CALLS").when(F.endswith(s, F.lit("#")), "REFERENCES")


def display_name(symbol: Column) -> Column:
    """The last descriptor of a symbol 'scheme manager package descriptors', without its marks; a symbol without blanks is its own name."""
    last = F.regexp_replace(F.element_at(F.split(symbol, " "), -1), r"\(*\)*\.*$", "")
    return F.when(F.contains(symbol, F.lit(" ")), F.element_at(F.split(last, "/"), -1)).otherwise(symbol)


def edge_kind(roles: Column, kind: Column, symbol: Column) -> Column:
    """An occurrence's edge: by import role, then the symbol's kind, then its suffix; null where none applies."""
    return F.when(roles.bitwiseAND(IMPORT_ROLE) != 0, "IMPORTS").when(kind.isin(*CALLABLE), "CALLS").when(kind.isin(*TYPES), "REFERENCES").otherwise(suffix_kind(symbol))


def enclosing(points: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """Each point (by, line, ..) with the last anchor (by, line, rank, symbol) at or before its line: an as-of
    join by one sort of both sides together. Of anchors on a line the highest rank wins, then the greatest symbol."""
    a = anchors.select(by, "line", F.lit(0).alias("_pt"), "rank", F.col("symbol").alias("anchor"))
    p = points.withColumns({"_pt": F.lit(1), "rank": F.lit(None).cast("int"), "anchor": F.lit(None).cast("string")})
    w = W.partitionBy(by).orderBy("line", "_pt", F.asc_nulls_first("rank"), "anchor").rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(a, allowMissingColumns=True).withColumn("anchor", F.last("anchor", ignorenulls=True).over(w))
    return both.where("_pt = 1").drop("_pt", "rank")


def symbol_kinds(symbols: DataFrame, externals: DataFrame | None) -> DataFrame:
    """(symbol, kind): its last definition's kind, even where that has none; a symbol that is nowhere defined has the kind of
    its first external row. Both are extremes of an order, so that a symbol that is in many documents is combined in the tasks."""
    last = symbols.groupBy("symbol").agg(F.max_by(F.struct("kind"), "place").alias("k"))
    if externals is None:
        return last.select("symbol", "k.kind")
    first = externals.groupBy("symbol").agg(F.min_by(F.struct("kind"), F.struct("part", "doc")).alias("x"))
    return last.join(first, "symbol", "full_outer").select("symbol", F.coalesce("k", "x")["kind"].alias("kind"))


def load(documents: DataFrame, project: str, externals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of symbol documents: relative_path, symbols[], occurrences[], and where there are several indexes
    part and doc, which give their order (else paths do); externals are (part, doc, symbol, kind). A symbol that several
    documents define is one entity: its first name, its last path, span and signature."""
    order = [c for c in ("part", "doc") if c in documents.columns]
    sym = documents.select(*order, "relative_path", F.posexplode("symbols").alias("i", "s")).select(F.struct(*order, "relative_path", "i").alias("place"), "relative_path", "s.*")
    kinds = symbol_kinds(sym, externals)
    occ = documents.select("relative_path", F.posexplode("occurrences").alias("i", "o")).select("relative_path", "i", "o.*")
    is_def = F.col("symbol_roles").bitwiseAND(1) != 0
    where = occ.where(is_def).groupBy("relative_path", "symbol").agg(F.max_by("range", "i").alias("range"))
    name = F.when(F.coalesce(F.col("display_name"), F.lit("")) != "", F.col("display_name")).otherwise(display_name(F.col("symbol")))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    ent = sym.join(where, ["relative_path", "symbol"], "left").withColumns({"name": name, "file_path": F.col("relative_path"), "line_range": F.when(F.col("range").isNotNull(), range_text(F.col("range")))})
    ent = ent.groupBy(F.col("symbol").alias("id")).agg(F.min_by("name", "place").alias("name"), known("file_path"), known("line_range"), known("signature"))
    ent = ent.select("id", F.lit("symbol").alias("kind"), "name", F.lit(project).alias("project"), "file_path", "line_range", "signature")
    line = F.get("range", F.lit(0)).alias("line")
    anchors = occ.where(is_def).join(kinds, "symbol", "left").where(F.col("kind").isin(*CALLABLE, *HOLDERS, *UNITS)).select("relative_path", line, F.when(F.col("kind").isin(*CALLABLE), 100).when(F.col("kind").isin(*HOLDERS), 50).otherwise(10).alias("rank"), "symbol")
    uses = occ.where(~is_def).select("relative_path", line, "symbol", "symbol_roles")
    edges = enclosing(uses, anchors, "relative_path").join(kinds, "symbol", "left").withColumn("edge", edge_kind(F.col("symbol_roles"), F.col("kind"), F.col("symbol")))
    rel = edges.where("anchor is not null and edge is not null and anchor <> symbol").select(F.col("anchor").alias("src"), F.col("symbol").alias("dst"), F.col("edge").alias("kind"))
    rs = sym.select(F.col("symbol").alias("src"), F.explode("relationships").alias("r")).select("src", F.col("r.symbol").alias("dst"), F.when(F.col("r.is_implementation"), "IMPLEMENTS").when(F.col("r.is_reference"), "EXTENDS").alias("kind")).where("kind is not null")
    rel = rel.unionByName(rs).select(F.sha2(F.concat_ws("|", "src", "dst", "kind"), 256).alias("id"), "src", "dst", "kind").distinct()
    seen = rel.select(F.col("dst").alias("id")).union(rel.select("src")).distinct().join(ent, "id", "left_anti")
    placeholders = seen.select("id", F.lit("symbol").alias("kind"), display_name(F.col("id")).alias("name"), F.lit(project).alias("project"), *[F.lit(None).cast("string").alias(c) for c in ("file_path", "line_range", "signature")])
    return ent.unionByName(placeholders), rel


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """By id: the new row claims the project and fills what it knows; name and kind stay as first stored."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    first = lambda c: F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    last = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return j.select(first("id"), first("kind"), first("name"), last("project"), last("file_path"), last("line_range"), last("signature"))


def replace_edges(relations: DataFrame, entities: DataFrame, project: str) -> DataFrame:
    """The relations left when a project's outgoing ones are dropped, build dependencies aside."""
    mine = entities.where(F.col("project") == project).select(F.col("id").alias("src"))
    return relations.join(mine, (relations["src"] == mine["src"]) & (relations["kind"] != "BAZEL_DEPENDS_ON"), "left_anti")


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that no relation touches. Ends are made distinct first, so a hub is one row."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return entities.join(ends, "id", "left_anti")


def stale(entities: DataFrame, relations: DataFrame, current: DataFrame, project: str) -> DataFrame:
    """Symbols of a project that are no longer indexed and that nothing touches."""
    return orphans(entities.where((F.col("project") == project) & (F.col("kind") == "symbol")).join(current.select("id"), "id", "left_anti"), relations)


def build_targets(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of build rules (name, rule_class, location, inputs[]): dependencies within the workspace."""
    at = r"^(.*):(\d+):[^:]*$"
    ent = rules.select(F.col("name").alias("id"), F.lit("bazel_target").alias("kind"), target_name(F.col("name")).alias("name"), F.regexp_extract("location", at, 1).alias("file_path"), F.regexp_extract("location", at, 2).alias("line"))
    deps = rules.select(F.col("name").alias("src"), F.explode("inputs").alias("dst")).join(rules.select(F.col("name").alias("dst")), "dst", "left_semi").where("src <> dst").distinct()
    return ent, deps.select("src", "dst", F.lit("BAZEL_DEPENDS_ON").alias("kind"))


def target_name(label: Column) -> Column:
    """What follows a label's last colon, or else its last slash."""
    return F.when(F.contains(label, F.lit(":")), F.substring_index(label, ":", -1)).otherwise(F.substring_index(label, "/", -1))


def target_rows(rules: DataFrame, root: str) -> DataFrame:
    """Rules of many projects (project, name, location) as entities to upsert: paths below ``root`` are relative to it; a
    location that is no 'file:line:column' gives neither path nor line."""
    at, below = r"^(.*):(\d+):[^:]*$", root.rstrip("/") + "/"
    file, line = F.regexp_extract("location", at, 1), F.regexp_extract("location", at, 2)
    path = F.when(F.startswith(file, F.lit(below)), F.substring(file, len(below) + 1, 1 << 30)).otherwise(file)
    return rules.select(F.col("name").alias("id"), F.lit("bazel_target").alias("kind"), target_name(F.col("name")).alias("name"), "project", F.when(line != "", path).alias("file_path"), F.when(line != "", F.concat(line, F.lit(":"), line)).alias("line_range"))


# ---- questions -----------------------------------------------------------------------------------
def resolve(entities: DataFrame, symbol: str, most: int = 8) -> DataFrame:
    q = F.lit(symbol)
    return entities.where((F.col("name") == q) | (F.col("id") == q)).orderBy(F.when(F.col("id") == q, 0).otherwise(1), "id").limit(most)


def gate(entities: DataFrame, patterns: DataFrame, most: int = 8) -> DataFrame:
    """(pattern, matches, redirect): a pattern is redirected to the graph if it has 1 to `most` matches; two equi joins, no OR join."""
    p = patterns.select("pattern").distinct()
    hit = p.join(entities.select(F.col("name").alias("pattern"), "id"), "pattern").union(p.join(entities.select(F.col("id").alias("pattern"), "id"), "pattern")).distinct()
    n = hit.groupBy("pattern").agg(F.count("*").alias("m"))
    out = p.join(n, "pattern", "left").select("pattern", F.least(F.coalesce("m", F.lit(0)), F.lit(most + 1)).cast("long").alias("matches"))
    return out.withColumn("redirect", F.col("matches").between(1, most))


def current(relations: DataFrame) -> DataFrame:
    return relations.where("not closed")


def edges_of(relations: DataFrame, entities: DataFrame, id_: str, outgoing: bool, limit: int) -> DataFrame:
    here, there = ("src", "dst") if outgoing else ("dst", "src")
    r = current(relations).where(F.col(here) == id_).select(F.col("id").alias("edge"), F.col("kind"), F.col(there).alias("other"))
    e = entities.select(F.col("id").alias("other"), "name", "project")
    return r.join(e, "other").orderBy("kind", "name", "edge").limit(limit)


def neighbourhood(relations: DataFrame, entities: DataFrame, id_: str, n: int = 30) -> DataFrame:
    """Outgoing edges up to half of n, and incoming ones up to what is left of n after those found."""
    out = edges_of(relations, entities, id_, True, max(n // 2, 1)).withColumn("direction", F.lit("out"))
    into = edges_of(relations, entities, id_, False, max(n, 1)).withColumn("direction", F.lit("in"))
    # both limits hold already, so these windows see a few dozen rows
    found = F.sum((F.col("direction") == "out").cast("long")).over(W.partitionBy(F.lit(0)))
    rank = F.row_number().over(W.partitionBy("direction").orderBy("kind", "name", "edge"))
    both = out.unionByName(into).withColumns({"_found": found, "_rank": rank})
    return both.where((F.col("direction") == "out") | (F.col("_rank") <= F.greatest(F.lit(n) - F.col("_found"), F.lit(1)))).drop("_found", "_rank")


def siblings(entities: DataFrame, id_: str, limit: int = 10, numeric_order: bool = False) -> DataFrame:
    """Other entities of the same file, in the order of their line ranges as text, or else as numbers."""
    me = entities.where(F.col("id") == id_).select("file_path").limit(1)
    order = F.split("line_range", ":")[0].cast("int") if numeric_order else F.col("line_range")
    return entities.where(F.col("id") != id_).join(me, "file_path", "left_semi").orderBy(order.asc_nulls_first(), "id").limit(limit).select("id", "name", "line_range")


def location(entities: DataFrame, project: str) -> DataFrame:
    at = F.concat_ws(":", "file_path", "line_range")
    return entities.select("id", F.when(F.col("project") != project, F.concat(F.lit("["), "project", F.lit("] "), at)).otherwise(at).alias("location"))


def markdown(head: str, edges: DataFrame, most: int = 8192) -> str:
    """A neighbourhood as Markdown; a bounded number of rows (the query's limits) is read."""
    rows, seen, lines = edges.collect(), set(), [f"# {head}"]
    for title, way in (("Calls and uses", "out"), ("Used by", "in")):
        part = []
        for r in rows:
            if r.direction == way and r.name and (way, r.kind, r.name) not in seen:
                seen.add((way, r.kind, r.name))
                part.append(f"- {r.kind} `{r.name}` ({r.project})")
        if part:
            lines += [f"## {title}", *part]
    out = ""
    for line in lines:
        if len((out + line).encode()) > most:
            return out + "… truncated\n"
        out += line + "\n"
    return out


# ---- queries -------------------------------------------------------------------------------------
def _points(s: SparkSession, d: str) -> DataFrame:
    li, o = domain.read(s, d, "lineitem"), domain.read(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    return li.join(o, "l_orderkey").select("cust", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("line"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("occ"))


def _anchors(s: SparkSession, d: str) -> DataFrame:
    return domain.read(s, d, "orders").select(F.col("o_custkey").alias("cust"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("line"), F.when(F.col("o_orderpriority") < "3", 2).otherwise(1).alias("rank"), F.concat(F.lit("o"), "o_orderkey").alias("symbol"))


def _f5(s: SparkSession, d: str) -> DataFrame:
    e = domain.entities(s, d)
    new = e.unionByName(e.withColumn("id", F.concat(F.lit("new-"), "id"))).withColumns({"name": F.upper("name"), "project": F.lit("/new"), "file_path": F.when(F.length("id") % 2 == 0, F.col("file_path")), "line_range": F.lit("1:1")})
    return upsert(e, new)


def _f8(s: SparkSession, d: str) -> DataFrame:
    p = domain.read(s, d, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Function", "Class", "Field", "Method")]), (F.col("p_partkey") % 4).cast("int") + 1)
    sym = F.concat(F.lit("scheme pkg/"), F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(F.lit("()."), F.lit("#"), F.lit(".")), (F.col("p_partkey") % 3).cast("int") + 1))
    return p.select("p_partkey", edge_kind((F.col("p_size") % 4).cast("int"), kind, sym).alias("edge"), display_name(sym).alias("name"))


def _c11(s: SparkSession, d: str) -> DataFrame:
    """Orders as build rules that depend on the order numbers next to them."""
    rules = domain.read(s, d, "orders").selectExpr("concat('//pkg:', o_orderkey) as name", "'rule' as rule_class", "concat('/w/BUILD:', o_custkey, ':1') as location", "array(concat('//pkg:', o_orderkey + 1), concat('//pkg:', o_orderkey), concat('//pkg:', o_orderkey * 2)) as inputs")
    return build_targets(rules)[1]


_p1 = lambda f: lambda s, d: f(domain.relations(s, d), domain.entities(s, d))
QUERIES = {
    "b9_resolve": lambda s, d: resolve(domain.entities(s, d), "Supplier#000000007").select("id", "name", "project"),
    "b10_gate": lambda s, d: gate(domain.entities(s, d), domain.read(s, d, "part").selectExpr("p_name as pattern").union(domain.read(s, d, "region").selectExpr("r_name"))),
    "f2_replace_edges": _p1(lambda r, e: replace_edges(r, e, "/p1")), "f5_upsert": _f5, "f8_classify": _f8, "f14_orphans": lambda s, d: orphans(domain.entities(s, d), current(domain.links(s, d))).select("id", "name"),
    "f13_stale": lambda s, d: stale(domain.entities(s, d), current(domain.links(s, d)), domain.entities(s, d).where("file_path <> 'BUILDING'"), "/p2").select("id"),
    "c9_asof_anchor": lambda s, d: enclosing(_points(s, d), _anchors(s, d), "cust").select("cust", "line", "occ", "anchor"), "c11_build_deps": _c11,
    "f18_out": _p1(lambda r, e: edges_of(r, e, "s:7", True, 15)), "f18_in": _p1(lambda r, e: edges_of(r, e, "p:7", False, 15)),
    "f19_neighbourhood": _p1(lambda r, e: neighbourhood(r, e, "s:7")), "f19_neighbourhood_used": _p1(lambda r, e: neighbourhood(r, e, "n:7")), "f20_siblings": lambda s, d: siblings(domain.entities(s, d), "p:7"), "f22_location": lambda s, d: location(domain.entities(s, d), "/p1"),
    "f16_degree": _p1(lambda r, e: current(r).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).join(e.select("id", "name"), "id")),
}

_R, _RE = duck("relations"), duck("relations", "entities")
_edge = lambda here, there, i, n: f"SELECT r.id AS edge, r.kind, r.{there} AS other, e.name, e.project FROM relations r JOIN entities e ON e.id = r.{there} WHERE NOT closed AND r.{here} = '{i}' ORDER BY r.kind, e.name, r.id LIMIT {n}"
ORACLES = {
    "b9_resolve": f"{duck('entities')} SELECT id, name, project FROM entities WHERE name = 'Supplier#000000007' OR id = 'Supplier#000000007' ORDER BY id LIMIT 8",
    "b10_gate": f"{duck('entities')}, p AS (SELECT p_name AS pattern FROM part UNION SELECT r_name FROM region), n AS (SELECT pattern, least(count(DISTINCT id), 9)::BIGINT AS m FROM p JOIN entities ON name = pattern OR id = pattern GROUP BY 1) SELECT pattern, coalesce(m, 0)::BIGINT AS matches, coalesce(m, 0) BETWEEN 1 AND 8 AS redirect FROM p LEFT JOIN n USING (pattern)",
    "f2_replace_edges": f"{_RE} SELECT * FROM relations WHERE kind = 'BAZEL_DEPENDS_ON' OR src NOT IN (SELECT id FROM entities WHERE project = '/p1')",
    "f5_upsert": f"{duck('entities')}, o AS (SELECT * FROM entities), n AS (SELECT id, kind, upper(name) AS name, '/new' AS project, CASE WHEN length(id) % 2 = 0 THEN file_path END AS file_path, '1:1' AS line_range, signature FROM (SELECT * FROM entities UNION ALL SELECT * REPLACE ('new-' || id AS id) FROM entities)) SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, coalesce(o.name, n.name) AS name, coalesce(n.project, o.project) AS project, coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.line_range, o.line_range) AS line_range, coalesce(n.signature, o.signature) AS signature FROM o FULL JOIN n ON o.id = n.id",
    "f8_classify": "SELECT p_partkey, CASE WHEN p_size % 4 IN (2, 3) THEN 'IMPORTS' WHEN p_partkey % 4 IN (0, 3) THEN 'CALLS' WHEN p_partkey % 4 = 1 THEN 'REFERENCES' WHEN p_partkey % 3 = 0 THEN 'CALLS' WHEN p_partkey % 3 = 1 THEN 'REFERENCES' END AS edge, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 1 THEN '#' ELSE '' END AS name FROM part",
    "f14_orphans": f"{domain.duck('entities', 'links')} SELECT id, name FROM entities WHERE id NOT IN (SELECT src FROM links WHERE NOT closed) AND id NOT IN (SELECT dst FROM links WHERE NOT closed)",
    "f13_stale": f"{domain.duck('entities', 'links')}, r AS (SELECT * FROM links WHERE NOT closed) SELECT id FROM entities WHERE project = '/p2' AND kind = 'symbol' AND file_path = 'BUILDING' AND id NOT IN (SELECT src FROM r) AND id NOT IN (SELECT dst FROM r)",
    "c9_asof_anchor": "WITH a AS (SELECT o_custkey AS cust, o_orderdate::DATE - DATE '1990-01-01' AS line, CASE WHEN o_orderpriority < '3' THEN 2 ELSE 1 END AS rank, 'o' || o_orderkey AS symbol FROM orders), b AS (SELECT cust, line, max_by(symbol, (rank, symbol)) AS anchor FROM a GROUP BY ALL), p AS (SELECT o_custkey AS cust, l_shipdate::DATE - DATE '1990-01-01' AS line, l_orderkey || '-' || l_linenumber AS occ FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT p.cust, p.line::INT AS line, occ, anchor FROM p ASOF LEFT JOIN b ON p.cust = b.cust AND p.line >= b.line",
    "c11_build_deps": "SELECT DISTINCT '//pkg:' || o_orderkey AS src, '//pkg:' || d AS dst, 'BAZEL_DEPENDS_ON' AS kind FROM (SELECT o_orderkey, unnest([o_orderkey + 1, o_orderkey * 2]) AS d FROM orders) WHERE d IN (SELECT o_orderkey FROM orders) AND d <> o_orderkey",
    "f18_out": f"{_RE} {_edge('src', 'dst', 's:7', 15)}", "f18_in": f"{_RE} {_edge('dst', 'src', 'p:7', 15)}",
    "f19_neighbourhood": f"{_RE} SELECT *, 'out' AS direction FROM ({_edge('src', 'dst', 's:7', 15)}) UNION ALL SELECT *, 'in' FROM ({_edge('dst', 'src', 's:7', 15)})",
    "f19_neighbourhood_used": f"{_RE}, o AS ({_edge('src', 'dst', 'n:7', 15)}), i AS ({_edge('dst', 'src', 'n:7', 30)}) SELECT *, 'out' AS direction FROM o UNION ALL SELECT * EXCLUDE k, 'in' FROM (SELECT *, row_number() OVER (ORDER BY kind, name, edge) AS k FROM i) WHERE k <= greatest(30 - (SELECT count(*) FROM o), 1)",
    "f20_siblings": f"{duck('entities')} SELECT id, name, line_range FROM entities WHERE id <> 'p:7' AND file_path = (SELECT file_path FROM entities WHERE id = 'p:7') ORDER BY line_range NULLS FIRST, id LIMIT 10",
    "f22_location": f"{duck('entities')} SELECT id, CASE WHEN project <> '/p1' THEN '[' || project || '] ' ELSE '' END || file_path || ':' || line_range AS location FROM entities",
    "f16_degree": f"{_RE} SELECT src AS id, count(*)::BIGINT AS n, any_value(e.name) AS name FROM relations r JOIN entities e ON e.id = r.src WHERE NOT closed GROUP BY 1",
}
