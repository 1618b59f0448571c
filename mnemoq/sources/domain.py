"""The engine's tables, derived from the driver's: each view as a DataFrame, and as a DuckDB CTE for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr(
        "concat(conv_id, '-', turn) as id", "cast(conv_id as string) as session_id", "role", "text as content",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0) as ts")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr("cast(conv_id as string) as id", "concat('/p', conv_id % 7) as project")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 10 <> 0").selectExpr("user_id as id", "concat('/p', user_id % 7) as project")


def tel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = {"click": "wrapped_cmd", "view": "retrieve", "purchase": "retrieve", "signup": "compress", "error": "index"}
    feature = {"click": "output_filter", "view": "recall", "purchase": "subgraph", "signup": "compress_ingest", "error": "codegraph_index"}
    pick = lambda m: F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in m.items()])
    return e.select(
        F.col("event_id").alias("seq"), pick(kind).alias("kind"), pick(feature).alias("feature"),
        F.when(F.col("k") % 11 != 0, F.concat(F.lit("f"), F.col("k") % 8)).alias("filter_id"), F.col("user_id").alias("session_id"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), (F.col("k") * 50).alias("output_tokens"), "ts")


def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as id", "element_at(array('decision', 'learning', 'preference', 'todo', 'note'), cast(doc_id % 5 as int) + 1) as kind",
        "text as content", "concat('/p', doc_id % 7) as project", "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0) as ts")


def bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").selectExpr(
        "item_id as id", "concat('/p', item_id % 7) as project", "substring_index(text, '\\n', 1) as summary", "if(item_id % 3 = 0, null, text) as content",
        "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, cast(item_id as int), 0) as ts", "item_id % 2 = 1 as resolved")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, p, k, name, file: read(spark, sf_dir, n).selectExpr(f"concat('{p}:', {k}) as id", "'symbol' as kind", f"{name} as name", f"concat('/p', {k} % 3) as project", f"{file} as file_path", f"concat({k}, ':', {k} + 5) as line_range", f"'sig ' || {name} as signature")
    return (t("nation", "n", "n_nationkey", "n_name", "concat('r', n_regionkey)").unionByName(t("supplier", "s", "s_suppkey", "s_name", "concat('n', s_nationkey)"))
            .unionByName(t("part", "p", "p_partkey", "p_name", "p_brand")).unionByName(t("customer", "c", "c_custkey", "c_name", "c_mktsegment")))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").selectExpr("concat('l', l_orderkey, '-', l_linenumber) as id", "concat('s:', l_suppkey) as src", "concat('p:', l_partkey) as dst", "'CALLS' as kind", "l_returnflag = 'R' as closed")
    s = read(spark, sf_dir, "supplier").selectExpr("concat('sn', s_suppkey) as id", "concat('s:', s_suppkey) as src", "concat('n:', s_nationkey) as dst", "'REFERENCES' as kind", "false as closed")
    c = read(spark, sf_dir, "customer").selectExpr("concat('cn', c_custkey) as id", "concat('c:', c_custkey) as src", "concat('n:', c_nationkey) as dst", "'IMPORTS' as kind", "false as closed")
    return li.unionByName(s).unionByName(c)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the parts they deliver, customers with their orders: some entities are in none."""
    li = read(spark, sf_dir, "lineitem").selectExpr("concat('s:', l_suppkey) as src", "concat('p:', l_partkey) as dst", "l_returnflag = 'R' as closed")
    return li.unionByName(read(spark, sf_dir, "orders").selectExpr("concat('c:', o_custkey) as src", "concat('o:', o_orderkey) as dst", "o_orderstatus <> 'P' as closed"))


DUCK = {
    "links": """links AS (SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_returnflag = 'R' AS closed FROM lineitem
        UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, o_orderstatus <> 'P' FROM orders)""",
    "messages": "messages AS (SELECT conv_id || '-' || turn AS id, conv_id::VARCHAR AS session_id, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations)",
    "sessions": "sessions AS (SELECT DISTINCT conv_id::VARCHAR AS id, '/p' || (conv_id % 7) AS project FROM conversations)",
    "user_sessions": "user_sessions AS (SELECT DISTINCT user_id AS id, '/p' || (user_id % 7) AS project FROM events WHERE user_id % 10 <> 0)",
    "tel_events": """tel_events AS (SELECT seq, kind, feature, CASE WHEN k % 11 <> 0 THEN 'f' || (k % 8) END AS filter_id, session_id, input_tokens, k * 50 AS output_tokens, ts FROM (
        SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'wrapped_cmd' WHEN 'view' THEN 'retrieve' WHEN 'purchase' THEN 'retrieve' WHEN 'signup' THEN 'compress' WHEN 'error' THEN 'index' END AS kind,
        CASE event_type WHEN 'click' THEN 'output_filter' WHEN 'view' THEN 'recall' WHEN 'purchase' THEN 'subgraph' WHEN 'signup' THEN 'compress_ingest' WHEN 'error' THEN 'codegraph_index' END AS feature,
        user_id AS session_id, floor(value * 100)::BIGINT AS input_tokens, (props::JSON->>'k')::BIGINT AS k, ts FROM events))""",
    "context_items": "context_items AS (SELECT doc_id::VARCHAR AS id, (['decision', 'learning', 'preference', 'todo', 'note'])[doc_id % 5 + 1] AS kind, text AS content, '/p' || (doc_id % 7) AS project, TIMESTAMP '2024-02-01' + to_minutes(doc_id::INT) AS ts FROM documents)",
    "bugs": "bugs AS (SELECT item_id AS id, '/p' || (item_id % 7) AS project, split_part(text, chr(10), 1) AS summary, CASE WHEN item_id % 3 <> 0 THEN text END AS content, TIMESTAMP '2024-03-01' + to_minutes(item_id::INT) AS ts, item_id % 2 = 1 AS resolved FROM benchmark)",
    "entities": """entities AS (SELECT 'n:' || n_nationkey AS id, 'symbol' AS kind, n_name AS name, '/p' || (n_nationkey % 3) AS project, 'r' || n_regionkey AS file_path, n_nationkey || ':' || (n_nationkey + 5) AS line_range, 'sig ' || n_name AS signature FROM nation
        UNION ALL SELECT 's:' || s_suppkey, 'symbol', s_name, '/p' || (s_suppkey % 3), 'n' || s_nationkey, s_suppkey || ':' || (s_suppkey + 5), 'sig ' || s_name FROM supplier
        UNION ALL SELECT 'p:' || p_partkey, 'symbol', p_name, '/p' || (p_partkey % 3), p_brand, p_partkey || ':' || (p_partkey + 5), 'sig ' || p_name FROM part
        UNION ALL SELECT 'c:' || c_custkey, 'symbol', c_name, '/p' || (c_custkey % 3), c_mktsegment, c_custkey || ':' || (c_custkey + 5), 'sig ' || c_name FROM customer)""",
    "relations": """relations AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, 'CALLS' AS kind, l_returnflag = 'R' AS closed FROM lineitem
        UNION ALL SELECT 'sn' || s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'REFERENCES', false FROM supplier
        UNION ALL SELECT 'cn' || c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'IMPORTS', false FROM customer)""",
}


def duck(*views: str) -> str:
    """The WITH clause that an oracle over these views begins with."""
    return "WITH " + ",\n".join(DUCK[v] for v in views)
