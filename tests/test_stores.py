"""Tables that are written in batches: vectors by key, and rows that are swept; nothing that wasn't published counts."""

import struct

import pytest
from pyspark.sql import functions as F

from mnemoq.functions import text
from mnemoq.sources import event_log, store, sweep, vectors

ROWS = "target_kind string, target_id string, model string, vector array<float>"


def kept(spark, path):
    return {(r.target_id, r.model): r.v for r in vectors.stored(spark, path).withColumn("v", vectors.decode("vector")).collect()}


def test_codec(spark):
    got = spark.createDataFrame([([1.0, -2.5, 3e-8],), ([],), (None,)], "v array<float>").select(vectors.encode("v").alias("b")).collect()
    assert [bytes(r.b) if r.b is not None else None for r in got] == [struct.pack("<3f", 1.0, -2.5, 3e-8), b"", None]
    torn = spark.createDataFrame([(bytearray(struct.pack("<2f", 0.5, 7.0) + b"\1\2\3"),), (bytearray(b"\1"),), (None,)], "b binary").select(vectors.decode("b").alias("v")).collect()
    assert [r.v for r in torn] == [[0.5, 7.0], [], None]


def test_latest_vector_of_a_key_holds(spark, monkeypatch):
    path = store.folder(spark, "vectors")
    assert vectors.stored(spark, path).count() == 0
    vectors.upsert(path, spark.createDataFrame([("message", "a", "m", [1.0]), ("message", "b", "m", [2.0]), ("message", "a", "n", [3.0]), ("message", "b", "m", [1.0])], ROWS).withColumn("seq", F.when(F.col("vector")[0] == 2.0, 2).otherwise(1)))
    vectors.upsert(path, spark.createDataFrame([("message", "a", "m", [9.0, 9.0]), ("entity", "a", "m", [0.0])], ROWS))
    assert vectors.stored(spark, path).where("target_kind = 'message'").count() == 3
    assert [r.v for r in vectors.stored(spark, path).where("target_kind = 'message' and target_id = 'a' and model = 'm'").select(vectors.decode("vector").alias("v")).collect()] == [[9.0, 9.0]]
    assert kept(spark, path)[("b", "m")] == [2.0]

    def lost(*_, **__):
        raise OSError("driver lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "commit", lost)
        vectors.upsert(path, spark.createDataFrame([("message", "b", "m", [5.0]), ("message", "new", "m", [5.0])], ROWS))
    assert kept(spark, path)[("b", "m")] == [2.0] and ("new", "m") not in kept(spark, path)


def test_reindex_embeds_what_is_missing(spark):
    path = store.folder(spark, "vectors")
    m = spark.createDataFrame([(i, f"m{9 - i}", "a" * i if i != 3 else None) for i in range(10)], "n long, id string, content string")
    run = lambda model="x", **k: vectors.reindex(m, path, "message", model, vectors.letters, 5, order="n", texts=3, **k)
    assert run(batch=4) == 4 and {k[0] for k in kept(spark, path)} == {"m9", "m8", "m7", "m6"}
    assert kept(spark, path)[("m7", "x")] == [2.0, 0.0, 0.0, 0.0, 2.0] and kept(spark, path)[("m6", "x")] == [0.0] * 5
    assert run() == 6 and run() == 0 and run("y", batch=3) == 3
    assert len(kept(spark, path)) == 13
    with pytest.raises(Exception, match="no . vectors of 4"):
        vectors.reindex(m, path, "message", "z", vectors.letters, 4)
    assert len(kept(spark, path)) == 13


def test_sweep_loses_and_repeats_nothing(spark, monkeypatch):
    long = "The engine reads every row of the table and keeps the best sentences. Short rows stay as they are. Nothing else happens here today! "
    rows = spark.createDataFrame([(i * 7, f"r{i}", None if i == 4 else long * (i % 3 * 3)) for i in range(11)], "rowid long, id string, content string")
    path = sweep.create(rows)
    before = {r.rowid: r.content for r in sweep.table(spark, path).collect()}
    first = sweep.step(spark, path, 4, 60)
    assert first["scanned"] == 4 and first["compressed"] == 2 and first["bytes_after"] < first["bytes_before"]

    def lost(*_, **__):
        raise OSError("driver lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(store, "commit", lost)
        sweep.step(spark, path, 4, 60)
    assert sweep.table(spark, path).where("swept").count() == 4 and sweep.table(spark, path).count() == 11
    assert [sweep.step(spark, path, 4, 60)["scanned"] for _ in range(2)] == [4, 3] and sweep.step(spark, path, 4, 60) is None
    sweep.add(path, spark.createDataFrame([(1000, "late", long * 9)], "rowid long, id string, content string"))
    assert sweep.step(spark, path, 4, 60)["compressed"] == 1 and sweep.step(spark, path, 4, 60) is None
    got = {r.rowid: r for r in sweep.table(spark, path).collect()}
    want = {r.rowid: r for r in text.gated(rows, least=60).withColumn("sha", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).collect()}
    assert len(got) == 12 and all((got[i].content, got[i].was_compressed, got[i].sha256) == (w.stored, bool(w.was_compressed), w.sha) for i, w in want.items())
    assert all(got[i].content == before[i] for i in before if not got[i].was_compressed)


def test_sweep_of_nothing(spark):
    path = sweep.create(spark.createDataFrame([], "rowid long, id string, content string"))
    assert sweep.step(spark, path, 4) is None and sweep.table(spark, path).count() == 0


def test_a_batch_with_a_wrong_event_is_refused(spark):
    path, schema = store.folder(spark, "events"), event_log.EVENT.split(", ", 1)[1]
    row = lambda kind: ("s", kind, "recall", None, 1, 2, 3)
    event_log.record(path, spark.createDataFrame([row("retrieve"), row("retrieve"), row("hook")], schema))
    for bad in ("other", None):
        with pytest.raises(ValueError, match="1 rows have an unknown kind"):
            event_log.record(path, spark.createDataFrame([row("index"), row(bad)], schema))
    got = event_log.events(spark, path).collect()
    assert sorted(r.kind for r in got) == ["hook", "retrieve", "retrieve"] and len({r.id for r in got}) == 3
    event_log.record(path, spark.createDataFrame([], schema))
    assert event_log.events(spark, path).count() == 3


def test_bugs_are_open_and_need_a_summary(spark):
    path, schema = store.folder(spark, "bugs"), "project string, summary string, content string"
    event_log.log_bugs(path, spark.createDataFrame([("/p", "one", None), ("/p", "two", "more")], schema))
    with pytest.raises(ValueError):
        event_log.log_bugs(path, spark.createDataFrame([("/p", None, "x")], schema))
    assert sorted((r.summary, r.content, r.resolved) for r in event_log.bugs(spark, path).collect()) == [("one", None, False), ("two", "more", False)]


def test_files_are_compressed_as_texts(spark, tmp_path):
    """Every file is a text of its own; what is written is what is read, and its events can be recorded."""
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    long = " ".join(f"The engine reads row {i} of the table and keeps the best sentences of it." for i in range(80))
    texts = {"a.md": long, "deep/b.txt": "Short text.\nTwo lines.", "c.txt": f"{text.MARK}\nalready", "d.txt": "é" * 10}
    for name, t in texts.items():
        (src / name).write_text(t)
    (src / "empty.txt").write_text("")
    got = {r.path.split("/in/")[1]: r for r in text.compress_files(spark, str(src)).collect()}
    rows = spark.createDataFrame(list(texts.items()), "id string, content string")
    want = {r.id: r for r in text.compress(rows).collect()}
    assert {k: (r.text, r.sha256, r.original, r.compressed) for k, r in got.items()} == {k: (r.text, r.sha256, r.original, r.compressed) for k, r in want.items()}
    assert got["a.md"].compressed < got["a.md"].original and got["c.txt"].text == texts["c.txt"]
    kept = text.compress_files(spark, str(src), str(tmp_path / "out"))
    assert {r.path.split("/in/")[1]: r.text for r in kept.collect()} == {k: r.text for k, r in got.items()} and (src / "a.md").read_text() == long
    path = store.folder(spark, "events")
    event_log.record(path, text.compress_events(kept))
    assert event_log.events(spark, path).agg(F.sum("input_tokens")).first()[0] == sum(r.original for r in got.values())


def test_a_drain_takes_a_bounded_number_of_jobs_and_does_what_steps_do(spark, monkeypatch):
    long = "The engine reads every row of the table and keeps the best sentences. Short rows stay as they are. Nothing else happens here today! "
    rows = spark.createDataFrame([(i * 7, f"r{i}", None if i == 4 else long * (i % 3 * 3)) for i in range(60)], "rowid long, id string, content string")
    one, all_, published = sweep.create(rows), sweep.create(rows), []
    steps = [got for _ in range(6) if (got := sweep.step(spark, one, 11, 60))]
    commit = store.commit
    monkeypatch.setattr(store, "commit", lambda *a, **k: published.append(len(a) - 3) or commit(*a, **k))
    assert sweep.drain(spark, all_, 11, 60, at_once=4) == steps and published == [4, 2] and [s["scanned"] for s in steps] == [11] * 5 + [5]
    assert sorted(map(str, sweep.table(spark, one).collect())) == sorted(map(str, sweep.table(spark, all_).collect()))
    sweep.add(all_, spark.createDataFrame([(1000, "late", long)], "rowid long, id string, content string"))
    assert [(r.id, r.content) for r in sweep.table(spark, all_).where("not swept").collect()] == [("late", long)]
    assert sweep.drain(spark, all_, 11, 60) != [] and sweep.table(spark, all_).where("swept").count() == 61
