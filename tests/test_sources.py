"""The line source, the live intake and the posting table: cut, replaced and torn files, restarts, segments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemoq.functions import shell
from mnemoq.operators import postings, redirect, retrieval, telemetry
from mnemoq.sources import domain, line_files, store, transcripts
from mnemoq.streaming import intake
from tests.conftest import SMALL


def lines_by_hand(data):
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line:
            out.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("split", ["1", "7", "64", "1k", "64m"])
def test_splits_give_each_line_once(spark, tmp_path, split):
    r = random.Random(1)
    size = 40 if split in ("1", "7") else 400
    files = {f"f{i}.jsonl": "\n".join("é" * r.choice([0, 1, 3, 40]) + str(j) * r.choice([0, 1]) for j in range(size)).encode() + (b"\ntorn" if i else b"\n") for i in range(3)}
    files |= {"empty": b"", "none": b"no break", "bad": b"\xff\xfe\n", ".hidden": b"x\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    line_files.register(spark)
    got = spark.read.format("line_files").option("split", split).load(str(tmp_path)).collect()
    want = sorted((str(tmp_path / n), a, v) for n, data in files.items() if n != ".hidden" for a, v in lines_by_hand(data))
    assert sorted((x.file, x.start, x.value) for x in got) == want
    assert all(x.first == files[x.file.rsplit("/", 1)[1]].split(b"\n")[0].decode("utf-8", "replace") for x in got)


def test_lines_longer_than_a_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_files, "PIECE", 16)
    data = b"a" * 100 + b"\n\n" + b"b" * 5 + b"\n" + b"c" * 33 + b"\nrest"
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as f:
        for split in (1, 10, 50, 1000):
            got = [x for r in line_files._ranges("f", 0, len(data), split) for x in line_files.lines_in(f, r.start, r.stop, r.end)]
            assert [(a, v.decode()) for a, v in got] == lines_by_hand(data)
        assert line_files._tail(f, len(data)) == data.rfind(b"\n") + 1 and line_files._tail(f, 50) == 0


def event(i, text="t", **more):
    return json.dumps({"type": "user", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": f"{text} {i}"}} | more) + "\n"


def test_stream_holds_back_restarts_and_rereads(spark, tmp_path):
    """A torn line waits; a stream goes on behind its checkpoint; cut and replaced files are read from their start; messages
    without an id of their own are all kept."""
    src, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    src.mkdir()

    def run():
        line_files.register(spark)
        q = spark.readStream.format("line_files").option("split", "100").load(str(src)).writeStream.option("checkpointLocation", str(log)).format("parquet").start(str(out))
        q.processAllAvailable()
        q.stop()
        return sorted(r.value for r in spark.read.parquet(str(out)).collect())

    a, b = src / "a", src / "b"
    a.write_text("1\n2\nto")
    b.write_text("b" * 300 + "\n")
    assert run() == ["1", "2", "b" * 300]
    a.write_text("1\n2\ntorn\n3")  # the line is finished, another begins
    assert run() == ["1", "2", "b" * 300, "torn"]
    a.write_text("1\n2\ntorn\n3\n")
    b.write_text("new\n")  # cut
    assert run() == ["1", "2", "3", "b" * 300, "new", "torn"]
    b.write_text("other\nand longer\n")  # replaced by a longer one
    b2 = run()
    assert b2 == sorted(["1", "2", "3", "b" * 300, "new", "torn", "other", "and longer"])
    a.unlink()
    assert run() == b2


def test_live_messages_without_ids_and_with_repeats(spark, tmp_path):
    (tmp_path / "a").write_text("".join(event(i) for i in range(5)) + event(7, uuid="u") + event(7, uuid="u"))
    (tmp_path / "b").write_text(json.dumps({"type": "session_meta", "payload": {"id": "z"}}) + "\n" + json.dumps({"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "one"}]}}) + "\n" + "no json\n")
    q = intake.stream_messages(spark, str(tmp_path)).writeStream.format("memory").queryName("live2").start()
    q.processAllAvailable()
    assert spark.sql("select * from live2").count() == 7
    with open(tmp_path / "a", "a") as f:
        f.write(event(7, uuid="u") + event(8)[:-1])
    q.processAllAvailable()
    assert spark.sql("select * from live2").count() == 7
    with open(tmp_path / "a", "a") as f:
        f.write("\n")
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from live2").collect()
    assert len(rows) == 8 and len({r.id for r in rows}) == 8


def test_windowed_savings_drop_late_rows(spark, tmp_path):
    cols = "kind string, feature string, filter_id string, session_id long, input_tokens long, output_tokens long, ts timestamp"
    src = tmp_path / "in"

    def put(rows):
        df = spark.createDataFrame([(a, b, t) for a, b, t in rows], "input_tokens long, output_tokens long, ts string").coalesce(1)
        df.selectExpr("'wrapped_cmd' AS kind", "'output_filter' AS feature", "'f' AS filter_id", "1L AS session_id", "input_tokens", "output_tokens", "to_timestamp(ts) AS ts").write.mode("append").parquet(str(src))

    put([(100, 40, "2024-01-01 10:10:00")])
    q = intake.windowed_savings(spark.readStream.schema(cols).parquet(str(src))).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("sav").start()
    q.processAllAvailable()
    put([(10, 5, "2024-01-01 10:50:00")])
    q.processAllAvailable()
    put([(7, 1, "2024-01-01 13:00:00")])
    q.processAllAvailable()
    put([(1000, 1, "2024-01-01 10:20:00"), (8, 1, "2024-01-01 13:30:00")])  # the first one is too late
    q.processAllAvailable()
    put([(9, 1, "2024-01-01 16:00:00")])
    q.processAllAvailable()
    q.stop()
    assert {(str(r.window.start)[11:13], r.n, r.saved) for r in spark.sql("select * from sav").collect()} == {("10", 2, 65), ("13", 2, 13)}
    assert telemetry.is_saving() is not None


def test_posting_table_scores_as_a_scan(spark):
    r = random.Random(5)
    words = ["a", "b", "Ça", "d-e", "f", "longer"] + [f"w{i}" for i in range(40)]
    rows = [(f"r{i}", " ".join(r.choice(words[: r.choice([3, 46])]) for _ in range(r.randint(0, 30))) if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, content string").repartition(3)
    path = postings.build(df.where("id < 'r15'"), buckets=8, spread=2)
    assert postings.add(path, df) > 0 and postings.add(path, df) == 0
    for q in ("a", "ca longer", "d-e", "a b", "nowhere", "w1 w2", '"*', "d-e a", "a-a b"):
        want = {x.id: x.score for x in retrieval.bm25(df, q).collect()}
        assert {x.id: x.score for x in postings.search(spark, path, q).collect()} == want, q
    assert {(x.id, x.dl) for x in postings.documents(spark, path).collect()} == {(x.id, x.n) for x in df.select("id", F.size(retrieval.tokens(F.col("content"))).alias("n")).collect()}


def test_posting_table_ignores_what_was_not_committed(spark, monkeypatch):
    df = spark.createDataFrame([("1", "red green"), ("2", "green blue")], "id string, content string")
    path = postings.build(df, buckets=4)

    def killed(*a, **k):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "commit", killed)
        with pytest.raises(RuntimeError):
            postings.add(path, spark.createDataFrame([("3", "green red red")], "id string, content string"))
    assert {x.id for x in postings.search(spark, path, "green").collect()} == {"1", "2"}
    assert postings.add(path, spark.createDataFrame([("3", "green red red")], "id string, content string")) == 1
    assert {x.id for x in postings.search(spark, path, "red").collect()} == {"1", "3"}


def test_search_reads_the_terms_folders_alone(spark):
    path = postings.index_of(spark, SMALL, "context_items")
    p = postings.postings(spark, path, ["what"], postings.BUCKETS)
    plan = p._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "segment" in filters and "EqualTo(term,what)" in plan
    read, whole = p.inputFiles(), spark.read.parquet(f"{path}/postings").inputFiles()
    assert p.select(F.input_file_name().alias("f")).distinct().count() * 8 < len(whole) and read
    plan = postings._items(spark, SMALL, retrieval.Q, 20)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # no text is tokenised for a search


def test_scope_and_brief_read_whole_tables(spark):
    got = transcripts.QUERIES["b12_brief"](spark, SMALL).collect()
    longest = max(len(r.brief) for r in got)
    assert longest > 400 and domain.links(spark, SMALL).count() > 6000


def test_rewriting_goes_by_the_first_argument():
    for left in ("go mod tidy", "gh pr list", "docker compose logs", "uv run pytest", "cargo t", "./gradlew build", "bat"):
        assert (shell.rewrite(left) is None) == (left != "bat"), left
    for done in ("git log\n", "  git log", "uv sync", "mocha", "docker images", "bazelisk build //x", "bazel cquery x", "yarn add y", "pnpm i"):
        assert shell.rewrite(done) == f"{shell.WRAPPER} {done.strip()}", done


def test_catch_up_over_two_clients(spark, tmp_path):
    """Only the project's own sessions: helpers' folders, other endings and other projects' files are passed over."""
    own, shared = tmp_path / "own", tmp_path / "shared"
    (own / "subagents").mkdir(parents=True)
    (shared / "2024" / "01" / "subagents").mkdir(parents=True)
    one = lambda i: json.dumps({"type": "user", "sessionId": "s", "cwd": "/p", "uuid": i, "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": f"text {i}"}}) + "\n"
    two = lambda i, cwd, kind="session_meta": json.dumps({"type": kind, "payload": {"id": i, "cwd": cwd}}) + "\n" + json.dumps({"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"of {i}"}]}}) + "\n"
    (own / "a.jsonl").write_text(one("a1") + one("a2") + one("torn")[:-1])
    (own / "b.txt").write_text(one("b"))
    (own / "subagents" / "c.jsonl").write_text(one("c"))
    where = shared / "2024" / "01"
    for name, text in {"d.jsonl": two("d", "/p"), "e.jsonl": two("e", "/p/"), "f.jsonl": two("f", "/p/x"), "g.jsonl": two("g", "/q"), "subagents/h.jsonl": two("h", "/p"), "i.jsonl": two("i", "/é \"x\""), "j.jsonl": two("j", "/p", "other"), "k.jsonl": "", "l.jsonl": "no json\n"}.items():
        (where / name).write_text(text)
    got = lambda *a: sorted(r.content for r in transcripts.catch_up(spark, *a, split="50").collect())
    assert got(str(own), str(shared), ["/p"]) == ["of d", "of e", "text a1", "text a2"]
    assert got(None, str(shared), ["/é \"x\"", "/q"]) == ["of g", "of i"]
    assert got(str(tmp_path / "none"), None, ["/p"]) == [] and got(None, None, ["/p"]) == []
    stored = transcripts.catch_up(spark, str(own), None, ["/p"])
    assert transcripts.new_rows(transcripts.catch_up(spark, str(own), str(shared), ["/p"]), stored).count() == 2


def test_searches_are_sent_to_the_graph(spark):
    patterns = {"rg foo": "foo", "grep -r -i foo src": "foo", "A=1 /usr/bin/rg 'fn foo' .": "fn foo", "rg foo | head": None, "sudo rg foo": None, "rg 'a|b'": "a|b", 'rg "$(x)"': "$(x)", "rg $(x)": None,
                "rg 'open": None, "rg -e": None, "rg foo && ls": None, r"rg foo\;": "foo;", "": None, " rg  x ": "x", "cat foo": None, "rg <<X": None}
    assert {c: shell.search_pattern(c) for c in patterns} == patterns and shell.search_pattern(None) is None
    e = spark.createDataFrame([("1", "foo"), ("2", "many"), *[(f"m{i}", "many") for i in range(8)], ("foo_id", "other"), (None, "foo"), ("9", None)], "id string, name string")
    c = spark.createDataFrame([(i, x) for i, x in enumerate(["rg foo", "rg foo", "rg many", "rg foo_id", "rg gone_sym", "git log", None, "rg two words", "rg 'no symbol'"])], "matches_of long, command string")
    got = {r.matches_of: r for r in redirect.redirects(c, e).collect()}
    assert len(got) == 9 and {i: (r.symbol, r.matches) for i, r in got.items() if r.symbol} == {0: ("foo", 2), 1: ("foo", 2), 2: ("many", 9), 3: ("foo_id", 1), 4: ("gone_sym", 0), 7: ("two", 0)}
    assert {i for i, r in got.items() if r.reason} == {0, 1, 3} and "(2 matches)" in got[0].reason and "(1 match)" in got[3].reason
    replies = {r.matches_of: json.loads(r.reply)["hookSpecificOutput"] if r.reply else None for r in redirect.replies(c, e).collect()}
    assert replies[0]["permissionDecision"] == "deny" and replies[5]["updatedInput"]["command"] == f"{shell.WRAPPER} git log" and replies[6] is None
    assert replies[2]["permissionDecision"] == "allow"
    assert redirect.redirects(c.limit(0), e).count() == 0 and redirect.redirects(c, e.limit(0)).where("reason is not null").count() == 0
