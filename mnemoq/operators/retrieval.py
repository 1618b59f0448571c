"""Retrieval: tokens, phrase match, BM25, searches over four targets, their merge, scopes, cosine and rank fusion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoq.sources import domain
from mnemoq.sources.domain import duck

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K, W_LEXICAL, W_SEMANTIC, W_RECENCY, POOL = 60, 1.0, 1.0, 0.5, 4

# fixed values: letters with their diacritics removed
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
_FOLD = str.maketrans(ACCENTED, PLAIN)


# ---- text ----------------------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrases(query: str) -> list[list[str]]:
    """A query's words, each as the tokens it must match side by side; quotes, stars, brackets and colons go."""
    out = [re.findall(r"[^\W_]+", re.sub(r'["*():]', "", w).translate(_FOLD).lower()) for w in query.split()]
    return [p for p in out if p]


def _frequency(toks: str, phrase: list[str]) -> Column:
    """How often the phrase occurs: within the row, by positions."""
    if len(phrase) == 1:
        return F.size(F.filter(F.col(toks), lambda t: t == F.lit(phrase[0])))
    same = lambda t, i: F.when(
        (t == F.lit(phrase[0])) & _all([F.get(F.col(toks), i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase) if k]), 1)
    return F.size(F.array_compact(F.transform(F.col(toks), same)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def preview(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


# ---- BM25 ----------------------------------------------------------------------------------------
def bm25(rows: DataFrame, query: str, text: str = "content") -> DataFrame:
    """rows that match all words of the query, with score, without a posting table: one pass for the statistics, one for the scores."""
    ps = phrases(query)
    if not ps:
        return rows.where("false").withColumn("score", F.lit(0.0))
    d = rows.withColumn("_tok", tokens(F.col(text))).withColumn("_dl", F.size("_tok"))
    for i, p in enumerate(ps):
        d = d.withColumn(f"_tf{i}", _frequency("_tok", p))
    s = d.agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(ps))]).first()  # one row
    n, avgdl = s.n, s.avgdl or 1.0
    score = F.lit(0.0)
    for i in range(len(ps)):
        df = s[f"df{i}"] or 0
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"_tf{i}")
        score = score + F.when(idf <= 0, FLOOR).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / avgdl))
    hit = _all([F.col(f"_tf{i}") > 0 for i in range(len(ps))])
    d = d.withColumn("score", F.round(score, 6)).where(hit)
    return d.drop("_tok", "_dl", *[f"_tf{i}" for i in range(len(ps))])


def best_of(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.desc_nulls_last("ts"), "id").limit(limit)


def _shape(df: DataFrame, target: str, pre: Column) -> DataFrame:
    return df.select(F.lit(target).alias("target"), F.col("id").cast("string").alias("id"), "score", F.col("ts"), pre.alias("preview"))


def search_bugs(bugs: DataFrame, query: str, limit: int) -> DataFrame:
    q = F.lower(F.lit(query))
    hit = F.contains(F.lower("summary"), q) | F.coalesce(F.contains(F.lower("content"), q), F.lit(False))
    return best_of(_shape(bugs.where(hit).withColumn("score", F.lit(1.0)), "bug", preview(F.coalesce("content", "summary"))), limit)


def search_entities(entities: DataFrame, query: str, limit: int) -> DataFrame:
    hit = entities.where(F.contains(F.lower("name"), F.lower(F.lit(query)))).withColumns({"score": F.lit(1.0), "ts": F.lit(None).cast("timestamp_ntz")})
    return best_of(_shape(hit, "entity", F.concat("kind", F.lit(": "), "name", F.lit(" ["), "project", F.lit("]"))), limit)


def merge(hits: list[DataFrame], limit: int) -> DataFrame:
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return best_of(out, limit)


# ---- vectors and fusion --------------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def hybrid(hits: DataFrame, vectors: DataFrame, query_vector: list[float], limit: int) -> DataFrame:
    """Reciprocal ranks of the lexical, semantic and recency orders of a bounded pool of candidates, summed by weight."""
    one = W.partitionBy(F.lit(0))  # the pool has at most POOL * limit rows
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    pool = best_of(hits, POOL * limit).withColumn("lex", F.row_number().over(one.orderBy(F.desc("score"), F.desc_nulls_last("ts"), "id")))
    pool = pool.join(vectors.select(F.col("id"), F.col("vector")), "id", "left").withColumn("cos", F.when(F.col("vector").isNotNull(), F.round(cosine(F.col("vector"), q), 6)))
    pool = pool.withColumn("sem", F.when(F.col("cos").isNotNull(), F.row_number().over(one.orderBy(F.desc_nulls_last("cos"), "id"))))
    pool = pool.withColumn("rec", F.when(F.col("ts").isNotNull(), F.row_number().over(one.orderBy(F.desc_nulls_last("ts"), "id"))))
    part = lambda w, r: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    fused = F.round(part(W_LEXICAL, "lex") + part(W_SEMANTIC, "sem") + part(W_RECENCY, "rec"), 9)
    return pool.select("target", "id", fused.alias("score"), "preview").orderBy(F.desc("score"), "id").limit(limit)


# ---- queries -------------------------------------------------------------------------------------
Q = "what from"
QM = "this from"  # of messages, which are short


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.messages(spark, sf_dir).select("id", "session_id").join(domain.sessions(spark, sf_dir).withColumnRenamed("id", "session_id"), "session_id")
    return m.select(F.col("project").alias("scope_id"), F.lit("message").alias("target_kind"), F.col("id").alias("target_id"))


def _e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.read(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").select("embedding").first()[0]])
    return v.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(20)


QUERIES = {
    "e7_bugs": lambda s, d: _out(search_bugs(domain.bugs(s, d), "THE", 20)),
    "e8_entities": lambda s, d: search_entities(domain.entities(s, d), "customer#00000001", 20).drop("ts"),
    "e12_cosine_topk": _e12,
    "b13_unembedded": lambda s, d: domain.context_items(s, d).join(domain.read(s, d, "embeddings").where("label < 8").selectExpr("cast(vec_id as string) as id"), "id", "left_anti").select("id", "kind"),
}

TOKENS_SQL = "regexp_extract_all(lower(translate(coalesce(content, ''), '" + ACCENTED + "', '" + PLAIN + r"')), '[\p{L}\p{N}]+')"
_PRE = lambda c: f"CASE WHEN length({c}) > 240 THEN left({c}, 240) || '…' ELSE {c} END"
_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def _bm(view: str, ps: list[list[str]], name: str = "bm") -> str:
    tf = [f"(len(list_filter(t, lambda x: x = '{p[0]}')))" if len(p) == 1 else "(len(list_filter(range(1, len(t) + 1), lambda i: " + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p)) + ")))" for p in ps]
    cols = ", ".join(f"{e} AS tf{i}" for i, e in enumerate(tf))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(ps)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(ps)))
    hit = " AND ".join(f"tf{i} > 0" for i in range(len(ps)))
    return f"""{name}_t AS (SELECT *, {cols}, len(t) AS dl FROM (SELECT *, {TOKENS_SQL} AS t FROM {view})),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats} FROM {name}_t),
{name} AS (SELECT {name}_t.*, round({score}, 6) AS score FROM {name}_t, {name}_s WHERE {hit})"""


_ORD = "ORDER BY score DESC, ts DESC NULLS LAST, id"
_MSG = lambda n, name="bm": f"SELECT 'message' AS target, id, score, ts, {_PRE('content')} AS preview FROM {name} {_ORD} LIMIT {n}"
_CTX = lambda n, name="bm": f"SELECT 'context' AS target, id, score, ts, {_PRE('content')} AS preview FROM {name} {_ORD} LIMIT {n}"
_BUG = lambda q, n: f"SELECT 'bug' AS target, id::VARCHAR AS id, 1.0::DOUBLE AS score, ts, {_PRE('coalesce(content, summary)')} AS preview FROM bugs WHERE contains(lower(summary), lower('{q}')) OR coalesce(contains(lower(content), lower('{q}')), false) {_ORD} LIMIT {n}"
_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x)))"
_w = lambda sql: f"SELECT target, id, score, {_TS}, preview FROM ({sql})"
_P2, _PM = phrases(Q), phrases(QM)
WHAT, M, C = "what", "m", "c"

ORACLES = {
    "e4_bm25_messages": f"{duck('messages')}, {_bm('messages', _PM)} SELECT id, score FROM bm",
    "e3_phrase": f"{duck('context_items')}, {_bm('context_items', phrases('of-the what'))} SELECT id, score FROM bm",
    "e5_recall_topk": f"{duck('messages')}, {_bm('messages', _PM)} {_w(_MSG(20))}",
    "e6_recall_context": f"{duck('context_items')}, {_bm('context_items', _P2)} {_w(_CTX(20))}",
    "e7_bugs": f"{duck('bugs')} {_w(_BUG('THE', 20))}",
    "e8_entities": f"{duck('entities')} SELECT 'entity' AS target, id, 1.0::DOUBLE AS score, kind || ': ' || name || ' [' || project || ']' AS preview FROM entities WHERE contains(lower(name), 'customer#00000001') ORDER BY id LIMIT 20",
    "e9_merge_targets": f"{duck('messages', 'context_items', 'bugs')}, {_bm('messages', [['what']], 'm')}, {_bm('context_items', [['what']], 'c')} {_w(f'SELECT * FROM (SELECT * FROM ({_MSG(10, M)}) UNION ALL SELECT * FROM ({_CTX(10, C)}) UNION ALL SELECT * FROM ({_BUG(WHAT, 10)})) {_ORD} LIMIT 15')}",
    "c2_scoped_recall": f"{duck('messages', 'sessions')}, {_bm('messages', _PM, 'all_hits')}, bm AS (SELECT h.* FROM all_hits h JOIN sessions s ON s.id = h.session_id WHERE project IN ('/p1', '/p3')) {_w(_MSG(20))}",
    "e12_cosine_topk": f"WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({_COS.format(a='embedding', b='e')}, 6) AS cos FROM embeddings, q ORDER BY cos DESC, vec_id LIMIT 20",
    "e16_rrf_hybrid": f"""{duck('context_items')}, {_bm('context_items', _P2)}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), p AS ({_CTX(80)}),
v AS (SELECT vec_id::VARCHAR AS id, round({_COS.format(a='embedding', b='e')}, 6) AS cos FROM embeddings, q WHERE label < 8),
r AS (SELECT target, id, preview, row_number() OVER (ORDER BY score DESC, ts DESC NULLS LAST, id) AS lex, CASE WHEN cos IS NOT NULL THEN row_number() OVER (ORDER BY cos DESC NULLS LAST, id) END AS sem, row_number() OVER (ORDER BY ts DESC, id) AS rec FROM p LEFT JOIN v USING (id))
SELECT target, id, round(1.0 / (60 + lex) + coalesce(1.0 / (60 + sem), 0) + 0.5 / (60 + rec), 9) AS score, preview FROM r ORDER BY score DESC, id LIMIT 20""",
    "b13_unembedded": f"{duck('context_items')} SELECT id, kind FROM context_items WHERE id NOT IN (SELECT vec_id::VARCHAR FROM embeddings WHERE label < 8)",
}
