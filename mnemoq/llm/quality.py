"""Quality rules (native): each document's hashed n-grams are scored by the log-likelihood ratio of
two multinomials, one of trusted texts and one of the whole raw corpus; the sum is divided by the
number of n-grams, and one fixed threshold decides on every document. Rules on counts come first.

Only DataFrame functions run: words, counts, buckets and score are arrays within a row, and the
corpus counts are one partial aggregation over ``buckets`` keys, so no key can grow hot and no text is
shuffled. The score table has ``buckets`` integers (millinats): it is sent with the plan, its size is
a parameter, and sums of integers do not depend on their order.

The trusted multinomial is fitted on at most ``max_trusted`` documents labelled good, taken by the
hash of their ids; the raw one on all documents. Both are smoothed by add-half. With no trusted
document at all, the ratio is 0 everywhere and the rules alone decide.

Defined cases: null and blank texts have no words, fail the rules and have score 0. Labels without a
document, null labels and repeated labels change nothing. Repeated rows each get their own result.
Very long texts are judged whole, an empty table gives no rows. Extra columns pass through ``judge`` and
``keep_good`` as they are, whatever their names, but for the prefix ``_q_`` of all columns made here.

The threshold: texts like the corpus as a whole have a ratio about 0, texts like the trusted ones more. At
-40 millinats a text is less likely under the trusted multinomial by a factor of e**-0.04 an n-gram,
e**-4 for a text of fifty words; the smoothing noise of rare buckets stays well above that.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fenced, table

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 13
MAX_TRUSTED = 20_000
THRESHOLD = -40  # millinats per n-gram
MIN_WORDS = 50


def _words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_q_w", F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), SPACES), ""))


def _grams(docs: DataFrame, buckets: int) -> DataFrame:
    """_q_g: the buckets of all words and of all pairs of neighbours."""
    one = f"transform(_q_w, w -> cast(pmod(xxhash64(w), {buckets}L) as int))"
    two = f"slice(transform(_q_w, (w, i) -> cast(pmod(xxhash64(w, get(_q_w, i + 1)), {buckets}L) as int)), 1, greatest(size(_q_w) - 1, 0))"
    return docs.withColumn("_q_g", F.expr(f"concat({one}, {two})"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[int]:
    """The score table: for each bucket the log ratio trusted : raw in millinats."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("_q_t", F.lit(1))
    base = _grams(_words(docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")), buckets)
    counts = base.select(F.col("_q_t"), F.explode_outer("_q_g").alias("g")).groupBy("g").agg(F.count("*").alias("raw"), F.sum("_q_t").alias("good")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:  # at most `buckets` rows, and one for documents without words
        if r.g is None:
            continue
        raw[r.g], target[r.g] = r.raw, r.good or 0
    n, m = sum(raw) + buckets / 2, sum(target) + buckets / 2
    if not any(target):
        return [0] * buckets
    return [round(1000 * (math.log((t + 0.5) / m) - math.log((c + 0.5) / n))) for t, c in zip(target, raw, strict=True)]


def judge(docs: DataFrame, scores: list[int], threshold: int = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs and _q_n_words, _q_word_chars, _q_n_symbols, _q_n_dup_lines, _q_n_repeat_words, _q_base_failed, _q_llr, _q_kept."""
    d = _grams(_words(docs), len(scores))
    d = d.withColumn("_q_lines", F.expr(r"filter(split(coalesce(text, ''), '\n', -1), l -> length(btrim(l, ' \t\n\u000b\f\r')) > 0)"))
    d = d.withColumn("_q_t", F.expr("slice(transform(_q_w, (w, i) -> xxhash64(w, get(_q_w, i + 1), get(_q_w, i + 2))), 1, greatest(size(_q_w) - 2, 0))"))
    # windows found twice lie side by side once sorted; most texts have none and skip the sort
    d = d.withColumn("_q_s", F.expr("if(size(array_distinct(_q_t)) = size(_q_t), null, sort_array(transform(_q_t, (h, i) -> struct(h as h, i as i))))"))
    again = "transform(_q_s, (x, j) -> if(x.h <=> get(_q_s, j - 1).h or x.h <=> get(_q_s, j + 1).h, x.i, null))"
    d = d.withColumn("_q_r", F.expr(f"array_compact({again})"))
    table_of = F.split(F.lit(",".join(map(str, scores))), ",").cast("array<int>")
    d = d.withColumn("_q_sum", F.aggregate("_q_g", F.lit(0).cast("long"), lambda a, g: a + F.get(table_of, g)))
    d = d.withColumns({
        "_q_n_words": F.size("_q_w").cast("long"),
        "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "_q_n_symbols": F.expr(r"cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') as bigint)"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_n_repeat_words": F.coalesce(F.size(F.array_distinct(F.flatten(F.expr("transform(_q_r, i -> array(i, i + 1, i + 2))")))).cast("long"), F.lit(0).cast("long")),
        "_q_llr": F.when(F.size("_q_g") > 0, F.col("_q_sum") / F.size("_q_g")).otherwise(F.lit(0.0)),
    })
    d = d.withColumn("_q_n_repeat_words", F.greatest("_q_n_repeat_words", F.lit(0).cast("long")))
    d = d.withColumn("_q_base_failed", (F.col("_q_n_words") < min_words) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words")))
    d = d.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_sum") >= F.size("_q_g").cast("long") * threshold))
    return d.drop("_q_w", "_q_g", "_q_lines", "_q_t", "_q_s", "_q_r", "_q_sum")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without those that the rules or the ratio reject; columns as they were."""
    out = judge(docs, fit(docs, labels), **how)
    return fenced(out, F.col("_q_kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")])
