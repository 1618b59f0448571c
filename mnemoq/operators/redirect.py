"""Searches for a symbol that the graph has are sent there: the pattern of a shell search, its symbol, the symbol's matches, a reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.functions import commands, shell
from mnemoq.operators import graph
from mnemoq.sources import domain

#: our own text; {} are the symbol, its number of matches, the plural's ending and the symbol again
REASON = ("`", "` is a symbol of the code graph (", " match", "). Ask for its neighbourhood instead of searching files; to search all the same, add a metacharacter, as in `", "\\b`.")


def redirects(searches: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """searches (with a column command) with symbol, matches (``most`` + 1 stands for all above) and reason, which is null where
    the command is left alone: it is no search, its pattern is no symbol, or the symbol has no match or more than ``most``.
    Symbols are counted once each, however often they are searched for; entities that no search names stay where they are."""
    s = searches.withColumn("symbol", commands.extract_symbol(shell.searched(F.col("command"))))
    n = graph.gate(entities, s.select(F.col("symbol").alias("pattern")).where("pattern is not null"), most).select(F.col("pattern").alias("symbol"), "matches")
    reason = F.concat(F.lit(REASON[0]), "symbol", F.lit(REASON[1]), F.col("matches").cast("string"), F.lit(REASON[2]), F.when(F.col("matches") == 1, "").otherwise("es"), F.lit(REASON[3]), "symbol", F.lit(REASON[4]))
    return s.join(n, "symbol", "left").select(*searches.columns, "symbol", "matches", F.when(F.col("matches").between(1, most), reason).alias("reason"))


def replies(searches: DataFrame, entities: DataFrame, most: int = 8) -> DataFrame:
    """searches with reply: a redirect is a refusal with its reason; what isn't redirected, but has a filter, is allowed as the
    wrapped command; null where the command runs as it is."""
    r = redirects(searches, entities, most).withColumn("wrapped", shell.rewritten(F.col("command")))
    allow = F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("allow").alias("permissionDecision"), F.struct(F.col("wrapped").alias("command")).alias("updatedInput")).alias("hookSpecificOutput")))
    reply = F.when(F.col("reason").isNotNull(), shell.hook_reply(F.lit("deny"), F.col("reason"))).when(F.col("wrapped").isNotNull(), allow)
    return r.select(*searches.columns, "symbol", "matches", reply.alias("reply"))


# ---- queries -------------------------------------------------------------------------------------
def _searches(s: SparkSession, d: str) -> DataFrame:
    """A shell command for each customer and part: searches of several shapes for names, some of one entity, some of many, some of none."""
    shapes = F.array(*[F.lit(x) for x in ("rg {n}", "grep -r -i {n} src", "A=1 /usr/bin/rg 'fn {n}' .", "rg {n} | head", "sudo rg {n}", "rg -n 'abc::{n}'", "cat {n}", "rg '{n} {n}'", "grep \"{n}(\" x.py", "rg 'open", "rg gone_{n}", "git log {n}")])
    name = lambda n: F.concat(F.lit("sym_"), F.regexp_replace(n, "[^A-Za-z0-9]+", "_"))
    shape = lambda k: F.element_at(shapes, (F.col(k) % 12).cast("int") + 1)
    one = lambda t, k, n: domain.read(s, d, t).select(F.concat(F.lit(t[0] + ":"), k).alias("id"), F.replace(shape(k), F.lit("{n}"), name(F.col(n))).alias("command"))
    return one("customer", "c_custkey", "c_mktsegment").unionByName(one("part", "p_partkey", "p_name"))


def _named(s: SparkSession, d: str) -> DataFrame:
    """Parts and some customers as symbols; segments are names of many."""
    e = lambda t, k, n: domain.read(s, d, t).select(F.concat(F.lit(t[0] + ":"), k).alias("id"), F.concat(F.lit("sym_"), F.regexp_replace(F.col(n).cast("string"), "[^A-Za-z0-9]+", "_")).alias("name"))
    return e("part", "p_partkey", "p_name").unionByName(e("customer", "c_custkey", "c_mktsegment").where("id < 'c:103'"))


_SHAPES = "CASE k % 12 WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n WHEN 5 THEN n WHEN 8 THEN n WHEN 10 THEN 'gone_' || n END"
QUERIES = {"i7_redirect": lambda s, d: redirects(_searches(s, d), _named(s, d)).select("id", "symbol", "matches", "reason")}
ORACLES = {"i7_redirect": f"""WITH a AS (SELECT 'c:' || c_custkey AS id, c_custkey AS k, 'sym_' || regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '_', 'g') AS n FROM customer
    UNION ALL SELECT 'p:' || p_partkey, p_partkey, 'sym_' || regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') FROM part),
s AS (SELECT id, {_SHAPES} AS symbol FROM a), e AS (SELECT id, n FROM a WHERE id[1] = 'p' OR id < 'c:103'), m AS (SELECT n, least(count(*), 9) AS matches FROM e GROUP BY 1)
SELECT id, symbol, CASE WHEN symbol IS NOT NULL THEN coalesce(matches, 0) END::BIGINT AS matches, CASE WHEN matches BETWEEN 1 AND 8 THEN
    '{REASON[0]}' || symbol || '{REASON[1]}' || matches || '{REASON[2]}' || CASE WHEN matches = 1 THEN '' ELSE 'es' END || '{REASON[3]}' || symbol || '{REASON[4]}' END AS reason FROM s LEFT JOIN m ON n = symbol"""}
