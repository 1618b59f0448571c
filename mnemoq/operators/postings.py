"""A posting table: for each term the rows that hold it, with positions and lengths, in folders by term, so that a search
reads its own terms' folders alone.

``build`` and ``add`` tokenise each new row once and shuffle its tokens once, by the term's bucket and a salt of the row's
id: a term that a third of all rows hold is dealt to ``spread`` tasks. Rows of a segment are written aside and become
part of the table by one commit, which also holds their count and tokens; a segment that was written but not committed
is never read. A row whose id is already in the table is passed over.

A search looks at (bucket, term), both pruned by the scan, and gives BM25 scores: how many rows hold a term is counted
from its own postings, how many rows there are and how long they are comes from the commits.

Defined cases: null text has no tokens, but counts as a row; a query without words finds nothing; rows with a null id
are left out, as nothing could be joined with them; of rows with one id in one call the first text in order stays.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoq.operators.retrieval import B, FLOOR, K1, POOL, Q, QM, _out, _shape, best_of, hybrid, merge, phrases, preview, search_bugs, tokens
from mnemoq.operators.retrieval import TOKENS_SQL
from mnemoq.operators.retrieval import members as scope_members
from mnemoq.sources import domain, store

BUCKETS, SPREAD = 64, 8
COMMIT = "segment string, rows long, tokens long, buckets int"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(rows: DataFrame, path: str | None = None, text: str = "content", buckets: int = BUCKETS, spread: int = SPREAD) -> str:
    """A new table of (id, text) rows; returns its path."""
    path = path or store.folder(rows.sparkSession, "postings")
    add(path, rows, text, buckets, spread)
    return path


def add(path: str, rows: DataFrame, text: str = "content", buckets: int = BUCKETS, spread: int = SPREAD) -> int:
    """Add the rows whose id is new; returns how many there were."""
    spark = rows.sparkSession
    done = store.commits(spark, path, COMMIT)
    had = done.orderBy("commit").limit(1).collect()
    buckets = had[0].buckets if had else buckets
    new = rows.where("id is not null").groupBy("id").agg(F.min(text).alias("t"))
    if had:
        new = new.join(documents(spark, path).select("id"), "id", "left_anti")
    segment = uuid.uuid4().hex
    length = new.select("id", tokens(F.col("t")).alias("tok")).select("id", "tok", F.size("tok").alias("dl"))
    length.select("id", "dl").write.parquet(f"{path}/documents/segment={segment}")
    t = length.select("id", "dl", F.posexplode("tok").alias("pos", "term"))
    t = t.withColumns({"bucket": _bucket(F.col("term"), buckets), "salt": F.pmod(F.xxhash64("id"), F.lit(spread))}).repartition("bucket", "salt")
    # the rows lie as they are grouped: no second shuffle
    p = t.groupBy("bucket", "salt", "term", "id", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions")).drop("salt")
    p.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    n = spark.read.parquet(f"{path}/documents/segment={segment}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    store.commit(spark, path, COMMIT, segment=segment, rows=n.n, tokens=n.t, buckets=buckets)
    return n.n


def _committed(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    names = [r.segment for r in store.commits(spark, path, COMMIT).select("segment").collect()]  # a row for each add()
    whole = spark.read.schema(schema + ", segment string" + ", bucket int" * (kind == "postings")).parquet(f"{path}/{kind}")
    return whole.where(F.col("segment").isin(names))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, dl): every row of the table and its number of tokens."""
    return _committed(spark, path, "documents", "id string, dl int").select("id", "dl")


def postings(spark: SparkSession, path: str, terms: list[str], buckets: int) -> DataFrame:
    """(term, id, dl, positions) of these terms: the scan is pruned to their folders."""
    p = _committed(spark, path, "postings", "term string, id string, dl int, positions array<int>")
    hit = reduce(lambda a, b: a | b, [(F.col("bucket") == _bucket(F.lit(t), buckets)) & (F.col("term") == t) for t in terms])
    return p.where(hit).select("term", "id", "dl", "positions")


def _frequency(phrase: list[str]) -> Column:
    """How often the words of a phrase lie side by side, from the map of positions by term."""
    first = F.element_at("at", F.lit(phrase[0]))
    if len(phrase) > 1:
        rest = [F.element_at("at", F.lit(w)) for w in phrase[1:]]
        first = F.filter(first, lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(r, p + k), F.lit(False)) for k, r in enumerate(rest, 1)]))
    return F.coalesce(F.size(first), F.lit(0)) if len(phrase) == 1 else F.when(first.isNull(), 0).otherwise(F.size(first))


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) of the rows that match all words of the query; equal to ``retrieval.bm25`` over the same rows."""
    ps = phrases(query)
    c = store.commits(spark, path, COMMIT).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.max("buckets").alias("b")).first()
    if not ps or not c.n:
        return spark.createDataFrame([], "id string, score double")
    terms = list(dict.fromkeys(w for p in ps for w in p))
    d = postings(spark, path, terms, c.b).groupBy("id", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # an entry a term, at most
    d = d.select("id", "dl", *[_frequency(p).alias(f"tf{i}") for i, p in enumerate(ps)])
    dfs = d.agg(*[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(ps))]).first()  # one row
    n, avgdl, score = c.n, c.t / c.n or 1.0, F.lit(0.0)
    for i in range(len(ps)):
        df = dfs[f"df{i}"] or 0
        idf = F.log(F.lit((n - df + 0.5) / (df + 0.5)))
        tf = F.col(f"tf{i}")
        score = score + F.when(idf <= 0, FLOOR).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    return d.where(reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(ps))])).select("id", F.round(score, 6).alias("score"))


def top(hits: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The best hits with their rows: ties are told apart by narrow columns, and only the rows that are left are read whole."""
    best = hits.join(rows.select("id", "ts"), "id").orderBy(F.desc("score"), F.desc_nulls_last("ts"), "id").limit(limit)
    return rows.join(F.broadcast(best.select("id", "score")), "id")  # limit rows


def search_messages(path: str, messages: DataFrame, query: str, limit: int, members: DataFrame | None = None) -> DataFrame:
    hits = search(messages.sparkSession, path, query)
    if members is not None:  # after scoring: a scope does not change what is rare in the corpus
        hits = hits.join(members.where("target_kind = 'message'").select(F.col("target_id").alias("id")), "id")
    return best_of(_shape(top(hits, messages, limit), "message", preview(F.col("content"))), limit)


def search_items(path: str, items: DataFrame, query: str, limit: int) -> DataFrame:
    return best_of(_shape(top(search(items.sparkSession, path, query), items, limit), "context", preview(F.col("content"))), limit)


# ---- queries -------------------------------------------------------------------------------------
_built: dict[tuple[str, str, str], str] = {}


def index_of(spark: SparkSession, sf_dir: str, view: str) -> str:
    """The posting table of a view, made once in a session: half of the rows by build, the others by add."""
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _built:
        rows = getattr(domain, view)(spark, sf_dir)
        path = build(rows.where("crc32(id) % 2 = 0"))
        add(path, rows)
        _built[key] = path
    return _built[key]


def _messages(s: SparkSession, d: str, query: str, limit: int, members: DataFrame | None = None) -> DataFrame:
    return search_messages(index_of(s, d, "messages"), domain.messages(s, d), query, limit, members)


def _items(s: SparkSession, d: str, query: str, limit: int) -> DataFrame:
    return search_items(index_of(s, d, "context_items"), domain.context_items(s, d), query, limit)


def _e16(s: SparkSession, d: str) -> DataFrame:
    v = domain.read(s, d, "embeddings").selectExpr("cast(vec_id as string) as id", "embedding as vector", "if(label < 8, 'm0', 'm1') as model")
    query = v.where("id = '0'").select("vector").first()[0]  # one vector
    return hybrid(_items(s, d, Q, POOL * 20), v.where("model = 'm0'"), query, 20)


def _terms(s: SparkSession, d: str) -> DataFrame:
    """The whole posting table of the items, by term: how many rows hold it, how often, and where first."""
    p = _committed(s, index_of(s, d, "context_items"), "postings", "term string, id string, dl int, positions array<int>")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("tf"), F.min(F.get("positions", F.lit(0))).alias("first"))


QUERIES = {
    "e3_phrase": lambda s, d: search(s, index_of(s, d, "context_items"), "of-the what"),
    "e4_bm25_messages": lambda s, d: search(s, index_of(s, d, "messages"), QM),
    "e5_recall_topk": lambda s, d: _out(_messages(s, d, QM, 20)),
    "e6_recall_context": lambda s, d: _out(_items(s, d, Q, 20)),
    "e9_merge_targets": lambda s, d: _out(merge([_messages(s, d, "what", 10), _items(s, d, "what", 10), search_bugs(domain.bugs(s, d), "what", 10)], 15)),
    "c2_scoped_recall": lambda s, d: _out(_messages(s, d, QM, 20, scope_members(s, d).where("scope_id in ('/p1', '/p3')"))),
    "d15_postings": _terms,
    "e16_rrf_hybrid": _e16,
}

ORACLES = {
    "d15_postings": f"{domain.duck('context_items')} SELECT t AS term, count(DISTINCT id) AS df, count(*) AS tf, min(i - 1)::INT AS first FROM (SELECT id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, {TOKENS_SQL} AS l FROM context_items)) GROUP BY 1",
}
