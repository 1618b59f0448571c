"""Benchmark decontamination (native): a hash set of normalised test n-grams is sent to every
task, training windows are scanned against it, hits are verified, and spans or documents go.

Main path, all DataFrame functions: the words of a document become one array; a position is a
candidate if the hash of its first two words is in the set of the windows' first two words; a
candidate is a hit if its whole window, as text, is in the set of windows (an exact test, so no
hash collision counts). All of it happens within the document's row: nothing is shuffled.

The set is sent with the plan as text only up to ``max_set`` windows. Beyond that bound two maps of hashes, of
MAP_SLOTS bytes each, are sent: positions whose two words, then whole windows whose hash, have their byte set are
candidates, still within the row. Only these, each window once a document, are joined with the windows' texts. A
crowded map lets more candidates through; the result is the same.

Defined cases: null text has no words, so no hit and is kept. An empty benchmark hits nothing. Items
shorter than the window are one window; items without words are none. Repeated rows each get their
own result. Very long texts are whole. Extra columns pass through, whatever their names; working columns are named with
the prefix ``_dc_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fenced, numbered, sql_strings, stored, table

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_SET = 50_000  # windows sent as literals
MAP_SLOTS = 1 << 22  # bytes of each map sent beyond that


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window, len, pair): each distinct window of each item, as words joined by spaces."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("i", F.explode(F.expr(f"sequence(1, greatest(size(w) - {window - 1}, 1))")))
    w = w.select("item_id", F.expr(f"slice(w, i, {window})").alias("w"))
    return w.select(
        "item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len"),
        F.xxhash64(F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("pair"),
    ).distinct()


def _hits_by_set(d: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds _dc_hits from the sets sent with the plan."""
    rows = windows.select("window", "len", "pair").distinct().collect()  # at most MAX_SET, checked by the caller
    if not rows:
        return d.withColumn("_dc_hits", F.expr("cast(array() as array<struct<pos:int,len:int,window:string>>)"))
    pairs = sorted({r.pair for r in rows if r.len > 1})
    pair_set = ", ".join(f"{p}L" if p != -(2**63) else "(-9223372036854775807L - 1L)" for p in pairs) or "NULL"
    d = d.withColumn(
        "_dc_cand",
        F.expr(f"filter(transform(_dc_w, (w, i) -> if(xxhash64(w, get(_dc_w, i + 1)) IN ({pair_set}), i + 1, 0)), i -> i > 0)"),
    )
    parts = []
    for n in sorted({r.len for r in rows}):
        texts = sql_strings(sorted(r.window for r in rows if r.len == n))
        if n == 1:
            at = f"filter(transform(_dc_w, (w, i) -> if(w IN ({texts}), i + 1, 0)), i -> i > 0)"
        else:
            at = f"filter(_dc_cand, i -> i + {n - 1} <= size(_dc_w) and array_join(slice(_dc_w, i, {n}), ' ') IN ({texts}))"
        parts.append(f"transform({at}, i -> struct(i as pos, {n} as len, array_join(slice(_dc_w, i, {n}), ' ') as window))")
    return d.withColumn("_dc_hits", F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]))


def _slot(h: Column, slots: int) -> Column:
    """The number of a hash's byte in a map of so many slots, a power of two; from 1 on."""
    return (h.bitwiseAND(F.lit(slots - 1)) + 1).cast("int")


def _slots_of(hashes: DataFrame, slots: int) -> bytes:
    """A byte for each slot, 1 where one of the hashes (column h) lies there."""
    at = hashes.select(_slot(F.col("h"), slots).alias("at")).distinct().toArrow().column("at").to_pylist()  # slots at most
    out = bytearray(slots)
    for i in at:
        out[i - 1] = 1
    return bytes(out)


def _hits_by_map(d: DataFrame, windows: DataFrame, slots: int = MAP_SLOTS) -> DataFrame:
    """Adds _dc_hits where the windows are too many for literals: two maps of hashes, of bounded size, are sent instead; what
    they let through meets the windows, as text, in a join."""
    grams = windows.select("window", "len", "pair").distinct()
    none = F.expr("cast(array() as array<struct<pos:int,len:int,window:string>>)")
    lens = sorted(r.len for r in grams.select("len").distinct().collect())
    if not lens:
        return d.withColumn("_dc_hits", none)
    pairs, texts = (F.lit(bytearray(_slots_of(h, slots))) for h in (grams.where("len > 1").select(F.col("pair").alias("h")), grams.select(F.xxhash64("window").alias("h"))))

    def among(sent: Column, h: Column) -> Column:
        return F.substring(sent, _slot(h, slots), 1) == F.lit(bytearray(b"\x01"))

    w = F.col("_dc_w")
    d = d.withColumn("_dc_cand", F.filter(F.transform(w, lambda x, i: F.when(among(pairs, F.xxhash64(x, F.get(w, i + 1))), i + 1).otherwise(0)), lambda i: i > 0))

    def windows_of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(w)) if n == 1 else F.filter("_dc_cand", lambda i: i + (n - 1) <= F.size(w))
        at = F.when(F.size(w) > 0, at).otherwise(F.expr("cast(array() as array<int>)"))
        found = F.transform(at, lambda i: F.struct(i.cast("int").alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, i, n), " ").alias("window")))
        return F.filter(found, lambda m: among(texts, F.xxhash64(m["window"])))

    parts = [windows_of(n) for n in lens]
    maybe = stored(fenced(d.select("_dc_id", F.concat(*parts).alias("_dc_maybe")), F.size("_dc_maybe") > 0).select("_dc_id", "_dc_maybe"), "bench-candidates")
    # a document's equal windows are one row; a common window's partition is split by adaptive execution
    met = maybe.select("_dc_id", F.explode(F.array_distinct(F.transform("_dc_maybe", lambda m: m["window"]))).alias("window")).join(grams.select("window").distinct(), "window", "left_semi")
    good = met.groupBy("_dc_id").agg(F.collect_set("window").alias("_dc_good"))
    hits = maybe.join(good, "_dc_id").select("_dc_id", F.filter("_dc_maybe", lambda m: F.array_contains("_dc_good", m["window"])).alias("_dc_hits"))
    return d.drop("_dc_cand").join(hits, "_dc_id", "left").withColumn("_dc_hits", F.coalesce("_dc_hits", none))


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> tuple[DataFrame, DataFrame]:
    """docs with _dc_id, _dc_w (words), _dc_hits (verified, every occurrence), _dc_n (words hit); and the windows."""
    windows = stored(benchmark_windows(benchmark, window), "bench-windows", 1)
    small = windows.limit(max_set + 1).count() <= max_set
    # the map's path reads the rows more than once and needs the same numbers each time
    d = docs.withColumn("_dc_id", F.monotonically_increasing_id()) if small else numbered(docs, "_dc_id")
    d = d.withColumn("_dc_w", words(F.col("text")))
    d = (_hits_by_set if small else _hits_by_map)(d, windows)
    # words covered: walk the hits by position, counting what lies past the end of those before
    d = d.withColumn("_dc_n", F.expr(
        "aggregate(array_sort(transform(_dc_hits, h -> struct(h.pos, h.len))), struct(0 as e, 0 as n),"
        " (s, h) -> struct(greatest(s.e, h.pos + h.len - 1) as e, s.n + greatest(0, h.pos + h.len - 1 - greatest(s.e, h.pos - 1)) as n), s -> cast(s.n as bigint))"))
    return d, windows


def contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs without the contaminated ones; the columns and all other rows as they were."""
    d, _ = annotate(docs, benchmark, window, max_set)
    return fenced(d, ~contaminated(F.col("_dc_n"), F.size("_dc_w").cast("long"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """docs whose texts lose the hit words, each with the separators after it; texts without a hit stay as they are."""
    d, _ = annotate(docs, benchmark, window, max_set)
    word = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    d = d.withColumn("_dc_p", F.expr(f"if(size(_dc_hits) = 0, array(), regexp_extract_all(text, r'({word}[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*)', 1))".replace("\\\\", "\\")))
    head = F.regexp_extract("text", r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]*", 0)
    left = F.expr("array_join(filter(transform(_dc_p, (p, i) -> if(exists(_dc_hits, h -> i + 1 >= h.pos and i + 1 < h.pos + h.len), null, p)), p -> p is not null), '')")
    cols = [F.when(F.size("_dc_hits") == 0, F.col("text")).otherwise(F.concat(head, left)).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return d.select(*cols)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_set: int = MAX_SET, max_broadcast: int = 1_000_000) -> DataFrame:
    """One row per input row: n_words, n_hit, n_items, items_sha256, contaminated. Only hits are joined to items."""
    d, windows = annotate(docs.select("doc_id", "text"), benchmark, window, max_set)
    items = windows.select("window", F.col("item_id").cast("string").alias("item"))
    if windows.limit(max_broadcast + 1).count() <= max_broadcast:
        items = F.broadcast(items)
    slim = d.select("_dc_id", "doc_id", F.size("_dc_w").cast("long").alias("n_words"), F.col("_dc_n").alias("n_hit"), F.expr("array_distinct(transform(_dc_hits, h -> h.window))").alias("g"))
    found = slim.select("_dc_id", "doc_id", "n_words", "n_hit", F.explode_outer("g").alias("window")).join(items, "window", "left")
    per = found.groupBy("_dc_id", "doc_id", "n_words", "n_hit").agg(F.sort_array(F.collect_set("item")).alias("i"))
    return per.select(
        "doc_id", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"),
        F.sha2(F.array_join("i", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_W} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_W} AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
