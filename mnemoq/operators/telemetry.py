"""Token savings from the event log: savings rules, roll-ups and the session budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemoq.sources import domain
from mnemoq.sources.domain import duck

SOFT, HARD = 100_000, 150_000

# ---- rules ---------------------------------------------------------------------------------------
SAVING_KINDS = ("compress", "wrapped_cmd")


def is_saving() -> Column:
    return F.col("kind").isin(*SAVING_KINDS) | (F.col("feature") == "subgraph")


def saved() -> Column:
    """Tokens saved by one event; a lookup never saves less than nothing."""
    d = F.col("input_tokens") - F.col("output_tokens")
    return F.when(F.col("feature") == "subgraph", F.greatest(d, F.lit(0).cast("long"))).otherwise(d)


def total_saved() -> Column:
    return F.coalesce(F.sum(saved()), F.lit(0)).cast("long")


def save_pct(s: Column, i: Column) -> Column:
    return F.when(i > 0, F.round(s / i * 100, 6)).otherwise(F.lit(0.0))


def item() -> Column:
    return F.when(F.col("feature") == "output_filter", F.coalesce("filter_id", "feature")).otherwise(F.col("feature"))


def source() -> Column:
    return (F.when(F.col("feature") == "subgraph", "codegraph").when(F.col("kind") == "wrapped_cmd", "command").when(F.col("kind") == "compress", "memory").otherwise("other"))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("input_tokens").cast("long").alias("input_tokens"), F.sum("output_tokens").cast("long").alias("output_tokens")]


# ---- reports -------------------------------------------------------------------------------------
def by_kind_feature(e: DataFrame) -> DataFrame:
    """The saving of lookups is cut at zero for the group here, not for each event."""
    g = e.groupBy("kind", "feature").agg(*_sums())
    d = F.col("input_tokens") - F.col("output_tokens")
    s = F.when(F.col("feature") == "subgraph", F.greatest(d, F.lit(0).cast("long"))).when(F.col("kind").isin(*SAVING_KINDS), d)
    return g.withColumn("saved", s)


def by_item(e: DataFrame) -> DataFrame:
    g = e.where(is_saving()).groupBy(item().alias("item")).agg(*_sums(), total_saved().alias("saved"))
    return g.withColumn("pct", save_pct(F.col("saved"), F.col("input_tokens")))


def by_source(e: DataFrame) -> DataFrame:
    g = e.where(is_saving()).groupBy(source().alias("source")).agg(*_sums(), total_saved().alias("saved"))
    return g.withColumn("pct", save_pct(F.col("saved"), F.col("input_tokens")))


def summary(e: DataFrame) -> DataFrame:
    s = e.where(is_saving()).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")], total_saved().alias("saved"))
    return s.withColumn("pct", save_pct(F.col("saved"), F.col("input_tokens")))


def by_time(e: DataFrame, bucket: str) -> DataFrame:
    d = F.to_date("ts")
    key = {"day": F.date_format(d, "yyyy-MM-dd"), "week": F.date_format(F.date_sub(d, F.dayofweek(d) - 1), "yyyy-MM-dd"), "month": F.date_format(d, "yyyy-MM")}[bucket]
    return e.where(is_saving()).groupBy(key.alias("bucket")).agg(*_sums(), total_saved().alias("saved"))


def by_project(e: DataFrame, sessions: DataFrame) -> DataFrame:
    # sums by session come first, so the join moves a row for each session only
    s = e.where(is_saving()).groupBy("session_id").agg(*_sums(), total_saved().alias("saved"))
    j = s.join(sessions.withColumnRenamed("id", "session_id"), "session_id", "left").groupBy(F.coalesce("project", F.lit("?")).alias("project"))
    return j.agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "input_tokens", "output_tokens", "saved")])


#: the totals of every_report, by the columns that they are grouped by
REPORTS = ("filter", "project", "day", "week", "month")


def every_report(e: DataFrame, sessions: DataFrame) -> DataFrame:
    """(report, key, n, input_tokens, output_tokens, saved): all savings by filter, project, day, week and month, and in all, from
    one scan and one grouping with sets. Events are summed up by session, filter and day first, so that the join and the
    sets work on those."""
    d = F.to_date("ts")
    s = e.where(is_saving()).groupBy("session_id", F.coalesce("filter_id", F.lit("-")).alias("filter"), d.alias("d")).agg(*_sums(), total_saved().alias("saved"))
    s = s.join(sessions.withColumnRenamed("id", "session_id"), "session_id", "left").select(
        "filter", F.coalesce("project", F.lit("?")).alias("project"), F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format(F.date_sub("d", F.dayofweek("d") - 1), "yyyy-MM-dd").alias("week"),
        F.date_format("d", "yyyy-MM").alias("month"), "n", "input_tokens", "output_tokens", "saved")
    g = s.groupingSets([[F.col(c)] for c in REPORTS] + [[]], *[F.col(c) for c in REPORTS]).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("n", "input_tokens", "output_tokens", "saved")], *[F.grouping(c).alias(f"_{c}") for c in REPORTS])
    pick = lambda of: F.coalesce(*[F.when(F.col(f"_{c}") == 0, of(c)) for c in REPORTS], F.lit("all"))
    return g.select(pick(F.lit).alias("report"), pick(F.col).alias("key"), "n", "input_tokens", "output_tokens", "saved").where("n is not null")


def by_session(e: DataFrame) -> DataFrame:
    return e.where(is_saving()).groupBy(F.coalesce(F.col("session_id").cast("string"), F.lit("?")).alias("session")).agg(*_sums(), total_saved().alias("saved"))


def history(e: DataFrame, n: int) -> DataFrame:
    return e.where(is_saving()).orderBy(F.desc("seq")).limit(n).select("seq", "kind", "feature", F.coalesce("filter_id", F.lit("-")).alias("filter_id"), "input_tokens", "output_tokens", saved().alias("saved"))


def daily_series(e: DataFrame, days: int, ref_date: str) -> DataFrame:
    d = F.to_date("ts")
    e = e.where(is_saving() & (d >= F.date_sub(F.lit(ref_date).cast("date"), days - 1)))
    return e.groupBy(F.date_format(d, "yyyy-MM-dd").alias("day")).agg(total_saved().alias("saved"))


def shares(e: DataFrame) -> DataFrame:
    g = by_source(e).select("source", "saved")
    total = F.sum("saved").over(W.partitionBy(F.lit(0)))  # over four sources
    return g.withColumn("share", F.round(F.col("saved") / F.greatest(total, F.lit(1)) * 100, 6))


def item_totals(e: DataFrame) -> DataFrame:
    g = e.where(is_saving()).withColumn("item", item()).rollup("item").agg(*_sums(), total_saved().alias("saved"))
    return g.select(F.coalesce("item", F.lit("TOTAL")).alias("item"), "n", "input_tokens", "output_tokens", "saved", F.when(F.col("input_tokens") > 0, F.round(F.col("output_tokens") / F.col("input_tokens"), 6)).otherwise(1.0).alias("ratio"))


def bars(e: DataFrame, width: int = 48) -> DataFrame:
    """Daily savings scaled to eighths of `width` characters."""
    g = by_time(e, "day").select("bucket", "saved")
    top = F.greatest(F.max("saved").over(W.partitionBy(F.lit(0))), F.lit(1))  # a row for each day
    return g.withColumn("eighths", F.round(F.greatest("saved", F.lit(0)) / top * width * 8).cast("long"))


def filter_ratios(e: DataFrame) -> DataFrame:
    return e.where("feature = 'output_filter' and filter_id is not null").groupBy("filter_id").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("input_tokens") != 0, F.col("output_tokens") / F.col("input_tokens"))), 6).alias("ratio"))


def top_savings(e: DataFrame, ref_date: str, n: int = 20) -> DataFrame:
    e = e.where(is_saving() & (F.to_date("ts") >= F.date_sub(F.lit(ref_date).cast("date"), 1)))
    return e.select("seq", "feature", saved().alias("saved")).orderBy(F.desc("saved"), "seq").limit(n)


def metrics(e: DataFrame) -> DataFrame:
    """Counters by kind and feature, as a metrics exporter would send them."""
    return e.groupBy("kind", "feature").agg(*_sums(), F.sum(F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0).cast("long"))).cast("long").alias("saved"))


# ---- budget --------------------------------------------------------------------------------------
def level(used: Column, soft: Column | int = SOFT, hard: Column | int = HARD) -> Column:
    soft, hard = (x if isinstance(x, Column) else F.lit(x) for x in (soft, hard))
    return F.when(used >= hard, 3).when(used >= soft, 2).when(used >= F.floor(soft / 2), 1).otherwise(0)


def budgets(e: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    if not 0 < soft <= hard:
        raise ValueError("limits must be 0 < soft <= hard")
    g = e.groupBy("session_id").agg(F.sum("output_tokens").cast("long").alias("used"))
    return g.select("session_id", "used", level(F.col("used"), soft, hard).alias("level"), F.round(F.col("used") / soft * 100, 6).alias("pct"))


def running_budget(e: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    w = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    r = e.withColumn("used", F.sum("output_tokens").over(w).cast("long"))
    return r.select("seq", "session_id", "used", level(F.col("used"), soft, hard).alias("level"))


def given() -> Column:
    """Whether a change of a budget sets limits."""
    return F.col("soft").isNotNull() | F.col("hard").isNotNull()


def valid() -> Column:
    return F.coalesce((F.col("soft") > 0) & (F.col("soft") <= F.col("hard")), F.lit(False))


def _limited(changes: DataFrame, over) -> DataFrame:
    c = changes.where("session_id is not null")
    last = F.max(F.when(given() & valid(), F.struct("seq", "soft", "hard")))
    return c, {"used": over(F.sum(F.coalesce("tokens", F.lit(0)))).cast("long"), "_l": over(last), "refused": over(F.count_if(given() & ~valid()))}


def _levels(rows: DataFrame, soft: int, hard: int, *names: str) -> DataFrame:
    if not 0 < soft <= hard:
        raise ValueError("limits must be 0 < soft <= hard")
    r = rows.withColumns({"soft": F.coalesce("_l.soft", F.lit(soft)).cast("long"), "hard": F.coalesce("_l.hard", F.lit(hard)).cast("long")})
    return r.select(*names, "used", "soft", "hard", level(F.col("used"), F.col("soft"), F.col("hard")).alias("level"), "refused")


def limited_budgets(changes: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """(session_id, used, soft, hard, level, refused) of changes (session_id, seq, tokens, soft, hard): the limits of the greatest
    seq hold; wrong ones are refused and counted."""
    c, sums = _limited(changes, lambda x: x)
    return _levels(c.groupBy("session_id").agg(*[v.alias(k) for k, v in sums.items()]), soft, hard, "session_id")


def running_limits(changes: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """The same after every change, by seq: new limits take what was used before into account at once."""
    w = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    c, sums = _limited(changes, lambda x: x.over(w))
    return _levels(c.withColumns({k: v for k, v in sums.items() if k != "refused"}).withColumn("refused", F.lit(None)).drop("soft", "hard"), soft, hard, "seq", "session_id").drop("refused")


# ---- histogram -----------------------------------------------------------------------------------
# fixed values: upper bounds of the buckets, as metrics exporters have them by default
BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)


def histogram(e: DataFrame, value: str = "latency_ms", bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """(kind, feature, bucket, n, total, least, most): values by bucket, of which the i-th ends with the i-th bound, bound included,
    and the last one has what is above all; negative values count in the first, nulls nowhere."""
    if list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds must rise")
    v = F.col(value)
    bucket = F.coalesce(*[F.when(v <= b, i) for i, b in enumerate(bounds)], F.lit(len(bounds)))
    return e.where(v.isNotNull()).groupBy("kind", "feature", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(v).cast("long").alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged(histograms: DataFrame) -> DataFrame:
    """Histograms of the same bounds, one after the other, as one."""
    return histograms.groupBy("kind", "feature", "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "total")], F.min("least").alias("least"), F.max("most").alias("most"))


# ---- queries -------------------------------------------------------------------------------------
def _q(f):
    return lambda spark, sf_dir: f(domain.tel_events(spark, sf_dir))


QUERIES = {
    "d1_kind_feature": _q(by_kind_feature), "d2_by_item": _q(by_item), "d3_by_source": _q(by_source), "d4_summary": _q(summary),
    "d5_daily": _q(lambda e: by_time(e, "day")), "d5_weekly": _q(lambda e: by_time(e, "week")), "d5_monthly": _q(lambda e: by_time(e, "month")),
    "d6_by_project": lambda s, d: by_project(domain.tel_events(s, d), domain.user_sessions(s, d)), "d6_by_session": _q(by_session),
    "d9_every_report": lambda s, d: every_report(domain.tel_events(s, d), domain.user_sessions(s, d)),
    "d7_history": _q(lambda e: history(e, 50)), "d8_series": _q(lambda e: daily_series(e, 7, "2024-01-20")), "d10_share": _q(shares), "d11_rollup": _q(item_totals), "d12_bars": _q(bars),
    "d16_avg_ratio": _q(filter_ratios), "d17_top_savings": _q(lambda e: top_savings(e, "2024-01-20")), "a34_metrics": _q(metrics), "d18_budget_running": _q(running_budget), "d19_levels": _q(budgets),
    "b2_saved": _q(lambda e: e.select("seq", F.when(is_saving(), saved()).alias("saved"))),
}

_E = duck("tel_events")
_S = "(kind IN ('compress', 'wrapped_cmd') OR feature = 'subgraph')"
_V = "CASE WHEN feature = 'subgraph' THEN greatest(input_tokens - output_tokens, 0) ELSE input_tokens - output_tokens END"
_A = "count(*)::BIGINT AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens"
_T = f"coalesce(sum({_V}), 0)::BIGINT AS saved"
_P = "CASE WHEN input_tokens > 0 THEN round(saved / input_tokens * 100, 6) ELSE 0.0 END AS pct"
_I = "CASE WHEN feature = 'output_filter' THEN coalesce(filter_id, feature) ELSE feature END"
_SRC = "CASE WHEN feature = 'subgraph' THEN 'codegraph' WHEN kind = 'wrapped_cmd' THEN 'command' WHEN kind = 'compress' THEN 'memory' ELSE 'other' END"
_L = "CASE WHEN used >= 150000 THEN 3 WHEN used >= 100000 THEN 2 WHEN used >= 50000 THEN 1 ELSE 0 END AS level"
_time = lambda key: f"{_E} SELECT {key} AS bucket, {_A}, {_T} FROM tel_events WHERE {_S} GROUP BY 1"

ORACLES = {
    "d1_kind_feature": f"{_E} SELECT *, CASE WHEN feature = 'subgraph' THEN greatest(input_tokens - output_tokens, 0) WHEN kind IN ('compress', 'wrapped_cmd') THEN input_tokens - output_tokens END AS saved FROM (SELECT kind, feature, {_A} FROM tel_events GROUP BY ALL)",
    "d2_by_item": f"{_E} SELECT *, {_P} FROM (SELECT {_I} AS item, {_A}, {_T} FROM tel_events WHERE {_S} GROUP BY 1)",
    "d3_by_source": f"{_E} SELECT *, {_P} FROM (SELECT {_SRC} AS source, {_A}, {_T} FROM tel_events WHERE {_S} GROUP BY 1)",
    "d4_summary": f"{_E} SELECT *, {_P} FROM (SELECT {_A}, {_T} FROM tel_events WHERE {_S})",
    "d5_daily": _time("strftime(ts, '%Y-%m-%d')"), "d5_weekly": _time("strftime(ts::DATE - dayofweek(ts)::INT, '%Y-%m-%d')"), "d5_monthly": _time("strftime(ts, '%Y-%m')"),
    "d9_every_report": f"{duck('tel_events', 'user_sessions')}, s AS (SELECT t.*, project FROM tel_events t LEFT JOIN user_sessions u ON u.id = t.session_id WHERE {_S}) "
    + " UNION ALL ".join(f"SELECT '{r}' AS report, {k} AS key, {_A}, {_T} FROM s GROUP BY ALL HAVING count(*) > 0" for r, k in (
        ("filter", "coalesce(filter_id, '-')"), ("project", "coalesce(project, '?')"), ("day", "strftime(ts, '%Y-%m-%d')"), ("week", "strftime(ts::DATE - dayofweek(ts)::INT, '%Y-%m-%d')"), ("month", "strftime(ts, '%Y-%m')"), ("all", "'all'"))),
    "d6_by_project": f"{duck('tel_events', 'user_sessions')} SELECT coalesce(project, '?') AS project, {_A}, {_T} FROM tel_events LEFT JOIN user_sessions ON id = session_id WHERE {_S} GROUP BY 1",
    "d6_by_session": f"{_E} SELECT coalesce(session_id::VARCHAR, '?') AS session, {_A}, {_T} FROM tel_events WHERE {_S} GROUP BY 1",
    "d7_history": f"{_E} SELECT seq, kind, feature, coalesce(filter_id, '-') AS filter_id, input_tokens, output_tokens, {_V} AS saved FROM tel_events WHERE {_S} ORDER BY seq DESC LIMIT 50",
    "d8_series": f"{_E} SELECT strftime(ts, '%Y-%m-%d') AS day, {_T} FROM tel_events WHERE {_S} AND ts::DATE >= DATE '2024-01-20' - 6 GROUP BY 1",
    "d10_share": f"{_E} SELECT *, round(saved / greatest(sum(saved) OVER (), 1) * 100, 6) AS share FROM (SELECT {_SRC} AS source, {_T} FROM tel_events WHERE {_S} GROUP BY 1)",
    "d11_rollup": f"{_E} SELECT coalesce(item, 'TOTAL') AS item, n, input_tokens, output_tokens, saved, CASE WHEN input_tokens > 0 THEN round(output_tokens / input_tokens, 6) ELSE 1.0 END AS ratio FROM (SELECT {_I} AS item, {_A}, {_T} FROM tel_events WHERE {_S} GROUP BY ROLLUP ({_I}))",
    "d12_bars": f"{_E} SELECT bucket, saved, round(greatest(saved, 0) / greatest(max(saved) OVER (), 1) * 384)::BIGINT AS eighths FROM (SELECT strftime(ts, '%Y-%m-%d') AS bucket, {_T} FROM tel_events WHERE {_S} GROUP BY 1)",
    "d16_avg_ratio": f"{_E} SELECT filter_id, count(*)::BIGINT AS n, round(avg(output_tokens / nullif(input_tokens, 0)), 6) AS ratio FROM tel_events WHERE feature = 'output_filter' AND filter_id IS NOT NULL GROUP BY 1",
    "d17_top_savings": f"{_E} SELECT seq, feature, {_V} AS saved FROM tel_events WHERE {_S} AND ts::DATE >= DATE '2024-01-20' - 1 ORDER BY saved DESC, seq LIMIT 20",
    "a34_metrics": f"{_E} SELECT kind, feature, {_A}, sum(greatest(input_tokens - output_tokens, 0))::BIGINT AS saved FROM tel_events GROUP BY ALL",
    "d18_budget_running": f"{_E} SELECT seq, session_id, used, {_L} FROM (SELECT seq, session_id, (sum(output_tokens) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM tel_events)",
    "d19_levels": f"{_E} SELECT session_id, used, {_L}, round(used / 100000 * 100, 6) AS pct FROM (SELECT session_id, sum(output_tokens)::BIGINT AS used FROM tel_events GROUP BY 1)",
    "b2_saved": f"{_E} SELECT seq, CASE WHEN {_S} THEN {_V} END AS saved FROM tel_events",
}
