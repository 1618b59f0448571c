"""Curated memory and scopes as append-only logs, workspace discovery over a listing of files, and streamed budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.operators.telemetry import level
from mnemoq.sources import domain

# fixed values: files that mark the root of a project, and the language each stands for
MARKERS = {"Cargo.toml": "rust", "go.mod": "go", "package.json": "typescript", "pyproject.toml": "python", "pom.xml": "java", "MODULE.bazel": "bazel", "WORKSPACE": "bazel"}
PRUNED = ("node_modules", "target", "vendor", "testdata", "dist", "build")


def add_rule(rules: DataFrame, new: DataFrame) -> DataFrame:
    return rules.unionByName(new)


def resolve_bugs(bugs: DataFrame, done: DataFrame) -> DataFrame:
    """Bugs with those in done (id) resolved; ids that are no bugs change nothing."""
    d = done.select("id").distinct().withColumn("_d", F.lit(True))
    return bugs.join(d, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_d", F.lit(False))).drop("_d")


def ensure_scopes(scopes: DataFrame, projects: DataFrame) -> DataFrame:
    """One scope for each project that has none; running it again adds nothing."""
    p = projects.select(F.col("project").alias("name")).distinct().join(scopes.select("name"), "name", "left_anti")
    return scopes.unionByName(p.select(F.sha2(F.concat(F.lit("project|"), "name"), 256).alias("id"), "name", F.lit(False).alias("archived")))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    key = ["scope_id", "target_kind", "target_id"]
    return members.unionByName(new.select(*key).distinct().join(members, key, "left_anti"))


def roots(files: DataFrame) -> DataFrame:
    """(root, languages): folders of a listing (path) that hold a marker file, none below a pruned or hidden folder."""
    name = F.element_at(F.split("path", "/"), -1)
    lang = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[name]
    ok = ~F.exists(F.split("path", "/"), lambda p: p.isin(*PRUNED) | F.startswith(p, F.lit(".")))
    return files.where(ok).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("root"), lang.alias("l")).where("l is not null").groupBy("root").agg(F.array_sort(F.collect_set("l")).alias("languages"))


def discover(files: DataFrame) -> DataFrame:
    """Roots whose languages no root above has claimed; a build root claims all below it. Each root looks up its own ancestors, an equi join."""
    r = roots(files)
    up = r.select("root", "languages", F.explode(F.expr("transform(sequence(1, size(split(root, '/')) - 1), i -> array_join(slice(split(root, '/'), 1, i), '/'))")).alias("above"))
    claims = up.join(r.select(F.col("root").alias("above"), F.col("languages").alias("claimed")), "above").groupBy("root").agg(F.flatten(F.collect_list("claimed")).alias("claimed"))
    left = r.join(claims, "root", "left").withColumn("claimed", F.coalesce("claimed", F.array().cast("array<string>")))
    left = left.where(~F.array_contains("claimed", "bazel")).select("root", F.array_except("languages", "claimed").alias("languages"))
    return left.where(F.size("languages") > 0)


def plan(r: DataFrame) -> DataFrame:
    """What indexing each root would do: the build graph where there is one, else one run for each language."""
    return r.select("root", F.when(F.array_contains("languages", "bazel"), "build_graph").when(F.size("languages") == 1, "single").otherwise("multi").alias("plan"))


def stream_budgets(events: DataFrame, soft: int, hard: int) -> DataFrame:
    """Sums and levels by session of a stream; the state store keeps one sum for each session."""
    return events.groupBy("session_id").agg(F.sum("output_tokens").alias("used")).withColumn("level", level(F.col("used"), soft, hard))


# ---- queries -------------------------------------------------------------------------------------
def _files(s: SparkSession, d: str) -> DataFrame:
    """Orders as files of a workspace three levels deep."""
    names = F.array(*[F.lit(n) for n in [*MARKERS, "readme.md", "lib.rs"]])
    o = domain.read(s, d, "orders")
    folder = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("w/a"), F.col("o_custkey") % 50)).when(F.col("o_orderkey") % 10 < 6, F.concat(F.lit("w/a"), F.col("o_custkey") % 50, F.lit("/b"), F.col("o_orderkey") % 40)).otherwise(F.concat(F.lit("w/vendor/c"), F.col("o_orderkey") % 90))
    return o.select(F.concat(folder, F.lit("/"), F.element_at(names, (F.col("o_orderkey") % 9).cast("int") + 1)).alias("path"))


def _scopes(s: SparkSession, d: str) -> DataFrame:
    p = domain.sessions(s, d).select("project").distinct()
    old = p.where("project < '/p3'").select(F.concat(F.lit("old"), "project").alias("id"), F.col("project").alias("name"), (F.col("project") == "/p0").alias("archived"))
    return ensure_scopes(ensure_scopes(old, p), p).select("name", "archived")


QUERIES = {
    "a26_discover": lambda s, d: discover(_files(s, d)).select("root", F.array_join("languages", ",").alias("languages")),
    "a28_plan": lambda s, d: plan(discover(_files(s, d))),
    "e11_scopes": _scopes,
    "j3_resolve_bugs": lambda s, d: resolve_bugs(domain.bugs(s, d), domain.read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))).select("id", "resolved"),
}
_F = "f AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'w/a' || (o_custkey % 50) WHEN o_orderkey % 10 < 6 THEN 'w/a' || (o_custkey % 50) || '/b' || (o_orderkey % 40) ELSE 'w/vendor/c' || (o_orderkey % 90) END AS root, (['rust', 'go', 'typescript', 'python', 'java', 'bazel', 'bazel', NULL, NULL])[o_orderkey % 9 + 1] AS l FROM orders), r AS (SELECT DISTINCT root, l FROM f WHERE l IS NOT NULL AND root NOT LIKE 'w/vendor/%')"
_DISC = f"WITH {_F}, k AS (SELECT r.root, r.l FROM r WHERE NOT EXISTS (SELECT 1 FROM r u WHERE starts_with(r.root, u.root || '/') AND (u.l = r.l OR u.l = 'bazel'))), g AS (SELECT root, list_sort(list(l)) AS ls FROM k GROUP BY root)"
ORACLES = {
    "a26_discover": f"{_DISC} SELECT root, array_to_string(ls, ',') AS languages FROM g",
    "a28_plan": f"{_DISC} SELECT root, CASE WHEN list_contains(ls, 'bazel') THEN 'build_graph' WHEN len(ls) = 1 THEN 'single' ELSE 'multi' END AS plan FROM g",
    "e11_scopes": "SELECT DISTINCT '/p' || (conv_id % 7) AS name, conv_id % 7 = 0 AS archived FROM conversations",
    "j3_resolve_bugs": "SELECT item_id AS id, item_id % 2 = 1 OR item_id IN (SELECT n_nationkey FROM nation) AS resolved FROM benchmark",
}
