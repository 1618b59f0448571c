"""Session budgets as state of a stream: tokens that add up, limits that change, and a level after every batch.

A change is (id, session_id, seq, ts, tokens, soft, hard): tokens are added, limits are set where one of soft and hard is
given, or both; a session has the default limits until then. Limits that are null, not positive, or soft over hard are
refused and counted. The limits of the greatest seq hold (of equal ones, the greater pair), whenever they arrive, so that
order and cuts into batches don't matter. Changes without a session are passed over; null tokens add nothing.

    changes --> each id once --> sums and latest limits of each Arrow batch --> state by session --> levels

What is summed up ahead of the shuffle is a row for each session and Arrow batch, so a hot session is no long group. A change
sent again adds nothing: its id is kept for ``replays``, beyond which late changes are dropped, too, or for good (None).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from mnemoq.operators.telemetry import HARD, SOFT, given, level, limited_budgets, running_limits, valid
from mnemoq.sources import domain, store, transcripts

CHANGE = "id string, session_id string, seq long, ts timestamp, tokens long, soft long, hard long"
_PART = "session_id string, used long, seq long, soft long, hard long, refused long, n long"
_STATE = "version long, used long, seq long, soft long, hard long, refused long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocks(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB, which state of this kind needs; the given one keeps its settings."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each session of an Arrow batch: sums, and the limits of the greatest seq (null if none)."""
    for b in batches:
        g = b.groupby("session_id", sort=False).agg(used=("tokens", "sum"), refused=("refused", "sum"), n=("id", "size"))
        top = b[b["sets"]].sort_values(["seq", "soft", "hard"]).drop_duplicates("session_id", keep="last").set_index("session_id")[["seq", "soft", "hard"]]
        yield g.join(top.astype("Int64")).reset_index()[["session_id", "used", "seq", "soft", "hard", "refused", "n"]]


class _Budgets(StatefulProcessor):
    """(version, used, seq, soft, hard, refused) by session; seq, soft and hard are null until limits are set."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("budget", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, used, *limits, refused = self.state.get() if self.state.exists() else (0, 0, None, None, None, 0)
        for r in rows:
            version, used, refused = version + r.n, used + r.used, refused + r.refused
            if r.seq is not None and (limits[0] is None or (r.seq, r.soft, r.hard) > tuple(limits)):
                limits = [r.seq, r.soft, r.hard]
        self.state.update((version, used, *limits, refused))
        yield Row(session_id=key[0], version=version, used=used, soft=limits[1], hard=limits[2], refused=refused)

    def close(self) -> None:
        pass


def stream(changes: DataFrame, replays: str | None = None, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """(session_id, version, used, soft, hard, level, refused) of each session that a batch changes; version counts its changes.
    The changes are a stream of a session that ``rocks`` gave."""
    if not 0 < soft <= hard:
        raise ValueError("limits must be 0 < soft <= hard")
    c = changes.where("session_id is not null")
    once = c.dropDuplicates(["id"]) if replays is None else c.withWatermark("ts", replays).dropDuplicatesWithinWatermark(["id"])
    rows = once.select("id", "session_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), (given() & valid()).alias("sets"), (given() & ~valid()).cast("long").alias("refused"),
                       *[F.when(given() & valid(), F.col(n)).otherwise(0).cast("long").alias(n) for n in ("seq", "soft", "hard")])
    state = rows.mapInPandas(_parts, _PART).groupBy("session_id").transformWithState(_Budgets(), "session_id string, version long, used long, soft long, hard long, refused long", "Append", "None")
    b = state.withColumns({"soft": F.coalesce("soft", F.lit(soft)).cast("long"), "hard": F.coalesce("hard", F.lit(hard)).cast("long")})
    return b.select("session_id", "version", "used", "soft", "hard", level(F.col("used"), F.col("soft"), F.col("hard")).alias("level"), "refused")


def start(changes: DataFrame, path: str, replays: str | None = None, **trigger) -> StreamingQuery:
    """Write the budgets to a log below ``path``; started again with the same path, the stream goes on where it was."""
    return stream(changes, replays).writeStream.option("checkpointLocation", f"{path}/state").trigger(**trigger or {"availableNow": True}).format("parquet").start(f"{path}/log")


def budgets(spark: SparkSession, path: str) -> DataFrame:
    """The budgets that a stream has written, each session's last."""
    return transcripts.latest(spark.read.parquet(f"{path}/log"), "session_id", "version")


# ---- queries -------------------------------------------------------------------------------------
def changes(s: SparkSession, d: str) -> DataFrame:
    """Events as changes: the index ones set limits, good and bad ones; all others add tokens."""
    sets = lambda c: F.when(F.col("kind") == "index", F.expr(c)).cast("long")
    return domain.tel_events(s, d).select(
        F.col("seq").cast("string").alias("id"), F.col("session_id").cast("string").alias("session_id"), "seq", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("kind") != "index", F.col("output_tokens")).alias("tokens"),
        sets("input_tokens + 1").alias("soft"), sets("input_tokens + output_tokens - 1000").alias("hard"))


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """All changes through the stream in three batches of files, the first files a second time in the last one."""
    path, own = store.folder(s, "budgets"), rocks(s)
    for at, rows in enumerate((changes(s, d).where("seq % 2 = 0"), changes(s, d).where("seq % 2 = 1"), changes(s, d).where("seq % 2 = 0"))):
        rows.coalesce(4).write.mode("append").parquet(f"{path}/in")
        start(own.readStream.schema(CHANGE).parquet(f"{path}/in"), path).awaitTermination()
    return budgets(s, path).select("session_id", "used", "soft", "hard", "level", "refused")


QUERIES = {"d20_limits": lambda s, d: limited_budgets(changes(s, d)), "d20_running_limits": lambda s, d: running_limits(changes(s, d)), "d20_stream": _streamed}
_C = f"""{domain.duck('tel_events')}, c AS (SELECT seq, session_id::VARCHAR AS session_id, CASE WHEN kind <> 'index' THEN output_tokens ELSE 0 END AS tokens,
    CASE WHEN kind = 'index' THEN input_tokens + 1 END AS soft, CASE WHEN kind = 'index' THEN input_tokens + output_tokens - 1000 END AS hard FROM tel_events),
v AS (SELECT *, soft > 0 AND soft <= hard AS ok FROM c WHERE session_id IS NOT NULL)"""
_LEVEL = "CASE WHEN used >= hard THEN 3 WHEN used >= soft THEN 2 WHEN used >= soft // 2 THEN 1 ELSE 0 END AS level"
_LATEST = f"""{_C}, g AS (SELECT session_id, sum(tokens)::BIGINT AS used, coalesce(arg_max(soft, seq) FILTER (ok), {SOFT})::BIGINT AS soft, coalesce(arg_max(hard, seq) FILTER (ok), {HARD})::BIGINT AS hard,
    count(*) FILTER (NOT ok) AS refused FROM v GROUP BY 1) SELECT session_id, used, soft, hard, {_LEVEL}, refused FROM g"""
_RUNNING = f"""{_C}, g AS (SELECT seq, session_id, (sum(tokens) OVER w)::BIGINT AS used, coalesce(last_value(CASE WHEN ok THEN soft END IGNORE NULLS) OVER w, {SOFT})::BIGINT AS soft,
    coalesce(last_value(CASE WHEN ok THEN hard END IGNORE NULLS) OVER w, {HARD})::BIGINT AS hard FROM v WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT seq, session_id, used, soft, hard, {_LEVEL} FROM g"""
ORACLES = {"d20_limits": _LATEST, "d20_running_limits": _RUNNING, "d20_stream": _LATEST}
