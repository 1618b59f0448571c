"""Budgets and metrics kept by streams: nothing is lost or counted twice over restarts, replays and batches that run again."""

import datetime
import pathlib
import random

import pytest

from mnemoq.operators import telemetry
from mnemoq.sources import domain, store
from mnemoq.streaming import budgets, metrics
from tests.conftest import SMALL

T = datetime.datetime(2024, 1, 1)
FIELDS = ("session_id", "used", "soft", "hard", "level", "refused")


def by_hand(rows, soft=100_000, hard=150_000):
    """Each session's budget, change by change in order of seq."""
    out = {}
    for _, session, _, _, tokens, s, h in sorted(rows, key=lambda r: r[2]):
        if session is None:
            continue
        b = out.setdefault(session, [0, soft, hard, 0])
        b[0] += tokens or 0
        if s is not None or h is not None:
            if s is None or h is None or s <= 0 or s > h:
                b[3] += 1
            else:
                b[1:3] = s, h
    level = lambda u, s, h: 3 if u >= h else 2 if u >= s else 1 if u >= s // 2 else 0
    return sorted((k, u, s, h, level(u, s, h), r) for k, (u, s, h, r) in out.items())


def some_changes(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        session = r.choice(["hot", "hot", "b", "c", None])
        limits = r.choice([(None, None)] * 5 + [(r.randrange(-5, 900), r.randrange(-5, 1800)), (None, 7), (50, None), (0, 10), (9, 9)])
        rows.append((f"i{i}", session, i, T, r.choice([None, 0, 5, 40]), *limits))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*FIELDS).collect())


def test_limits_against_plain_python(spark):
    rows = some_changes(300, 1)
    df = spark.createDataFrame(rows, budgets.CHANGE)
    assert rows_of(telemetry.limited_budgets(df)) == by_hand(rows)
    got = {r.seq: r for r in telemetry.running_limits(df).collect()}
    for i in range(0, 300, 17):
        if rows[i][1] is not None:
            want = next(b for b in by_hand(rows[: i + 1]) if b[0] == rows[i][1])
            assert (got[i].used, got[i].soft, got[i].hard, got[i].level) == want[1:5]
    assert telemetry.limited_budgets(df.limit(0)).count() == 0
    for wrong in ((0, 5), (6, 5)):
        with pytest.raises(ValueError, match="soft"):
            telemetry.limited_budgets(df, *wrong)


def test_stream_counts_each_change_once_over_restarts(spark):
    """400 increments, in any order, over five starts, with whole files sent again: all count, none twice."""
    path, own = store.folder(spark, "budgets"), budgets.rocks(spark)
    rows = [(f"i{i}", "one" if i % 3 else "two", i, T, 1, None, None) for i in range(400)]
    limits = [("l1", "one", 500, T, None, 200, 266), ("l0", "one", 400, T, None, 5, 6), ("bad", "two", 501, T, None, 9, 3)]
    mixed = rows + limits
    random.Random(2).shuffle(mixed)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != budgets._ROCKS
    for at in range(5):
        part = mixed[at * 81 : at * 81 + 81] + (mixed[: 81] if at == 3 else [])
        spark.createDataFrame(part, budgets.CHANGE).coalesce(2).write.mode("append").parquet(f"{path}/in")
        budgets.start(own.readStream.schema(budgets.CHANGE).parquet(f"{path}/in"), path).awaitTermination()
    assert rows_of(budgets.budgets(spark, path)) == by_hand(mixed) == [("one", 266, 200, 266, 3, 0), ("two", 134, 100_000, 150_000, 0, 1)]
    assert sum(r.version for r in budgets.budgets(spark, path).collect()) == 403


def test_stream_equals_the_batch_form(spark):
    path, own, rows = store.folder(spark, "budgets"), budgets.rocks(spark), some_changes(500, 3)
    for at in range(0, 500, 250):
        spark.createDataFrame(rows[at : at + 250], budgets.CHANGE).write.mode("append").parquet(f"{path}/in")
        budgets.start(own.readStream.schema(budgets.CHANGE).parquet(f"{path}/in"), path, "1 day").awaitTermination()
    assert rows_of(budgets.budgets(spark, path)) == by_hand(rows)


def test_histograms_merge(spark):
    e = spark.createDataFrame([("k", "f", v) for v in (-3, 0, 1, 5, 6, 10, 10000, 10001, None)] + [("k", "g", 7)], "kind string, feature string, latency_ms long")
    got = {(r.feature, r.bucket): (r.n, r.total, r.least, r.most) for r in telemetry.histogram(e).collect()}
    assert got == {("f", 0): (2, -3, -3, 0), ("f", 1): (2, 6, 1, 5), ("f", 2): (2, 16, 6, 10), ("f", 14): (1, 10000, 10000, 10000), ("f", 15): (1, 10001, 10001, 10001), ("g", 2): (1, 7, 7, 7)}
    halves = telemetry.histogram(e.where("latency_ms % 2 = 0")).unionByName(telemetry.histogram(e.where("latency_ms % 2 <> 0")))
    assert {(r.feature, r.bucket): (r.n, r.total, r.least, r.most) for r in telemetry.merged(halves).collect()} == got
    assert telemetry.histogram(e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        telemetry.histogram(e, bounds=(1, 1))


def test_a_batch_that_runs_again_replaces_its_delta(spark):
    """A batch is sent, its commit is lost, and the stream is started again: the counters are those of one run."""
    path, e = store.folder(spark, "metrics"), domain.tel_events(spark, SMALL)
    e.repartition(3, "seq").write.parquet(f"{path}/in")
    run = lambda: metrics.start(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path, "input_tokens").awaitTermination()
    run()
    last = max(pathlib.Path(f"{path}/state/commits".removeprefix("file://")).glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run()
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert rows(metrics.counters(spark, path)) == rows(telemetry.metrics(e).select("kind", "feature", "n", "input_tokens", "output_tokens", "saved"))
    assert rows(metrics.histogram(spark, path)) == rows(telemetry.histogram(e, "input_tokens"))
