"""The engine's own operators: oracle twins at the smallest scale, and cases by hand."""

import json
import math
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemoq import registry
from mnemoq.functions import commands, text
from mnemoq.operators import graph, retrieval, telemetry
from mnemoq.sources import transcripts
from mnemoq.streaming import intake
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(list(commands.PLANTED)[2:])))
def test_query_matches_its_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        duck.execute(registry.ORACLES[name])
        assert got == rows_of([d[0] for d in duck.description], duck.fetchall())


def test_bm25_as_sqlite_computes_it(spark):
    docs = ["alpha beta gamma", "beta beta delta", "café x_y foo-bar", "foo bar baz beta", "gamma delta"] + ["filler words only"] * 6
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(content)")
    db.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(docs)))
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, content string")
    for q in ("beta", "beta delta", "cafe", "foo-bar", "x"):
        match = " ".join(f'"{w}"' for w in q.split())
        want = {i: -s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        got = {r.id: r.score for r in retrieval.bm25(rows, q).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in got), q
    assert retrieval.bm25(rows, ' "*" ').count() == 0


def test_savings_rules(spark):
    e = [(1, "compress", "compress", 1000, 400), (2, "retrieve", "subgraph", 800, 150), (3, "index", "codegraph_index", 5_000_000, 0), (4, "retrieve", "recall", 0, 200), (5, "retrieve", "subgraph", 0, 150)]
    df = spark.createDataFrame(e, "seq long, kind string, feature string, input_tokens long, output_tokens long")
    s = telemetry.summary(df.where("seq < 5")).first()
    assert (s.n, s.input_tokens, s.output_tokens, s.saved) == (2, 1800, 550, 1250)
    assert telemetry.summary(df.where("seq = 5")).first().saved == 0
    assert telemetry.summary(df.where("false")).first().saved == 0


def test_budget_levels(spark):
    got = spark.createDataFrame([(u,) for u in (0, 60, 100, 150)], "used long").select(telemetry.level(F.col("used"), 100, 150).alias("l")).collect()
    assert [r.l for r in got] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        telemetry.budgets(None, 200, 100)


SYMBOL_DOCS = "relative_path string, symbols array<struct<symbol:string, display_name:string, kind:string, signature:string, relationships:array<struct<symbol:string, is_implementation:boolean, is_reference:boolean>>>>, occurrences array<struct<symbol:string, range:array<int>, symbol_roles:int>>"


def test_loading_symbols(spark):
    d = spark.createDataFrame([("src/lib.rs", [("foo", "foo", "Function", None, []), ("bar", "bar", "Function", None, [])], [("foo", [0, 0, 3], 1), ("bar", [10, 0, 3], 1), ("bar", [5, 2, 5], 0)])], SYMBOL_DOCS)
    ent, rel = graph.load(d, "/p")
    assert {(r.id, r.file_path, r.line_range) for r in ent.collect()} == {("foo", "src/lib.rs", "1:1"), ("bar", "src/lib.rs", "11:11")}
    assert [(r.src, r.dst, r.kind) for r in rel.collect()] == [("foo", "bar", "CALLS")]
    assert "- CALLS `bar`" in graph.markdown("foo", graph.neighbourhood(rel.withColumn("closed", F.lit(False)), ent, "foo"))
    assert graph.orphans(ent, rel.where("false")).count() == 2


def test_compressor_is_idempotent(spark):
    long = " ".join(f"Sentence {i} talks about topic{i % 7} and the plan." for i in range(300))
    rows = spark.createDataFrame([("a", long), ("b", ""), ("c", None), ("d", "short one.")], "id string, content string")
    once = {r.id: r for r in text.compress(rows, 0.3).collect()}
    assert once["a"].ratio < 0.5 and once["b"].text == text.MARK + "\n" and once["b"].ratio == 1.0
    again = text.compress(spark.createDataFrame([(k, r.text) for k, r in once.items()], "id string, content string"), 0.3).collect()
    assert all(r.text == once[r.id].text for r in again)


def test_command_filters(spark):
    log = "".join(f"commit {i:040x}\nAuthor: a\nDate: b\n\n    Subject {i}\n\n    body\n\n" for i in range(50))
    cargo = "".join(f"   Compiling c{i} v0.1\n" for i in range(80)) + "warning: unused\n"
    frames = [("git", ["-C", "x", "log"], log, "git_log"), ("/usr/bin/cargo", ["build"], cargo, "cargo_build"), ("go", ["mod", "tidy"], "go: downloading x\n", "go_mod_tidy"), ("what", [], "a\na\na\n", "generic"),
              ("git", ["diff"], "diff --git a b\n@@ -1 +1 @@\n-x\n+y\n+z\n", "git_diff"), ("kubectl", ["describe"], "Name: x\nLabels: a\n  b\nConditions:\n  Ready True\nSpec:\n  y\nSelector: z\nStatus: ok\n", "kubectl_describe"), ("rg", ["x"], "f:1:a\ng:2:b\nf:3:c\n", "rg")]
    df = spark.createDataFrame([(i, c, a, o, "", 0) for i, (c, a, o, _) in enumerate(frames)], "i int, cmd string, args array<string>, stdout string, stderr string, exit_code int")
    out = {r.i: r for r in commands.filtered(df).collect()}
    assert [out[i].filter_id for i in range(len(frames))] == [f[3] for f in frames]
    assert len(out[0].text) < 0.3 * len(log) and out[0].text.endswith("50 commits\n")
    assert out[1].text == "warning: unused\n[1 warnings, 0 errors, exit 0]\n"
    assert out[2].text == "[dropped 1 progress lines, exit 0]\n"
    assert out[3].text == "[compressed]\n+ 2 more identical lines\n"  # the article goes
    assert "+2 -1 :: -x" in out[4].text and out[5].text == "Name: x\nConditions:\n  Ready True\nStatus: ok\n[describe trimmed, exit 0]\n"
    assert out[6].text == "f:1:a\ng:2:b\nf:3:c\n"  # no path by its look


def test_planted_outputs(spark):
    """All of them in one pass; the twins of two are run above, those of the others by the driver."""
    rows = [(name, n, cmd, args.split(), out.replace("{n}", str(n)), "", code) for name, (cmd, args, out, code, _) in commands.PLANTED.items() for n in (1, 23, 456)]
    got = commands.filtered(spark.createDataFrame(rows, "name string, n int, cmd string, args array<string>, stdout string, stderr string, exit_code int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == commands.PLANTED[r.name][4].replace("{n}", str(r.n)), r.name


def test_filters_shrink_what_tools_print(spark):
    """How much is left of long, typical outputs; the lines that matter stay."""
    cargo = "".join(f"   Compiling c{i} v0.1\n" for i in range(200)) + "".join(f"warning: w{i}\n  --> a.rs:{i}:1\n   |\n 9 | x\n   | ^\n   = note: n\n\n" for i in range(20)) + "error: bad\n  --> b.rs:1:1\n"
    tests = "".join(f"test t{i} ... ok\n" for i in range(400)) + "---- t9 stdout ----\npanicked\nstack backtrace:\n" + "   0: f\n" * 90 + "\ntest result: FAILED\n"
    rg = "".join(f"src/very/long/path/of/a/file{i % 6}.rs:{i}:match\n" for i in range(190))
    cases = [("cargo", ["build"], cargo, 0.35, "error: bad"), ("cargo", ["test"], tests, 0.1, "panicked"), ("rg", ["match"], rg, 0.5, "189:match"), ("pytest", [], "a.py::t PASSED\n" * 300 + "E x\n", 0.05, "E x")]
    out = commands.filtered(spark.createDataFrame([(i, c, a, o, "", 1) for i, (c, a, o, *_) in enumerate(cases)], "i int, cmd string, args array<string>, stdout string, stderr string, exit_code int")).collect()
    for r in out:
        _, _, raw, most, must = cases[r.i]
        assert len(r.text) < most * len(raw) and must in r.text, r.filter_id


def test_automata_hold_strange_frames(spark):
    from mnemoq.functions import automata

    frames = [(1, "cargo", ["build"], None, None, None), (2, "cat", None, "x\n", "", 0), (3, "rg", ["-l", "x"], "a\nb\n", "", 0), (4, "rg", ["x"], '{"a":1}\n', "", 0), (5, "rg", ["x"], "a.rs:" + "y" * 3000 + "\n", "", 0),
              (6, "rg", ["x"], "".join(f"f{i % 3}.rs:{i}:m\n" for i in range(500)), "", 0), (7, "what", [], "", "", 0), (8, "gh", ["pr", "view"], "--\n" * 3, "", 0)]
    got = {r.i: r.text for r in commands.filtered(spark.createDataFrame(frames, "i int, cmd string, args array<string>, stdout string, stderr string, exit_code int")).collect()}
    assert got[1] == "[0 warnings, 0 errors, exit ?]\n" and got[2] == "x\n" and got[3] == "a\nb\n" and got[4] == '{"a":1}\n' and got[7] == "" and got[8] == "--\n" * 3
    assert got[5] == "a.rs:" + "y" * 1000 + "…\n" and got[6].endswith("[300 more matches]\n") and got[6].count("\n") == 203
    assert all(t.trailer is None or automata.fold(n, [], 0)[0] == [] for n, t in automata.TABLES.items())


def test_transcripts_of_both_shapes(spark, tmp_path):
    a = [{"type": "user", "sessionId": "s", "uuid": "u1", "message": {"role": "user", "content": "hi"}}, {"type": "assistant", "sessionId": "s", "uuid": "u2", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yo"}]}},
         {"type": "tool", "sessionId": "s", "uuid": "u3"}, {"type": "user", "sessionId": "s", "uuid": "u4", "isSidechain": True, "message": {"content": "no"}}]
    b = [{"type": "session_meta", "payload": {"id": "z", "cwd": "/w"}}, {"type": "event_msg"}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "one"}]}}]
    for name, x in (("a", a), ("b", b)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(e) + "\n" for e in x))
    found = transcripts.parse(transcripts.read_lines(spark, str(tmp_path)))
    off = sum(len(json.dumps(e)) + 1 for e in b[:2])
    assert {(r.id, r.role, r.content) for r in found.collect()} == {("u1", "user", "hi"), ("u2", "assistant", "[thinking] hm\nyo"), (f"codex-z-{off}", "user", "one")}
    assert transcripts.new_rows(found, found).count() == 0
    q = intake.stream_messages(spark, str(tmp_path)).writeStream.format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id for r in spark.sql("select id from live").collect()} == {"u1", "u2", f"codex-z-{off}"}


def test_plans_stay_in_the_engine(spark):
    for name in ("d6_by_project", "f14_orphans", "c9_asof_anchor", "g11_greedy", "e4_bm25_messages", "e6_recall_context"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_every_report_is_one_grouping(spark):
    df = registry.QUERIES["d9_every_report"](spark, SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Union") == 0
    assert {r.report for r in df.collect()} == {*telemetry.REPORTS, "all"}


@pytest.mark.parametrize(("outs", "want"), [(0, (0, 30)), (4, (4, 26)), (40, (15, 15))])
def test_neighbourhood_gives_incoming_edges_what_is_left(spark, outs, want):
    rel = [(f"o{i}", "hub", f"e{i}", "CALLS", False) for i in range(outs)] + [(f"i{i:02}", f"e{i}", "hub", "CALLS", False) for i in range(45)]
    ent = spark.createDataFrame([(f"e{i}", f"name{i:02}", "/p") for i in range(45)], "id string, name string, project string")
    got = graph.neighbourhood(spark.createDataFrame(rel, "id string, src string, dst string, kind string, closed boolean"), ent, "hub").collect()
    into = sorted(r.edge for r in got if r.direction == "in")
    assert (len(got) - len(into), len(into)) == want and into == [f"i{i:02}" for i in range(want[1])]


def test_runs_of_strange_texts_are_as_in_the_twin(spark, tmp_path):
    texts = [None, "", "\n", "\n\n\n", "\r\n", "a\r\nb\r\n", "\r", "abc\nabc\nabc", "abc\r\nabc", "é́x\né́x", "\U0001f600", "x\0y\x85z w", "  \n  ", "a\n\n\nb\n", "no break", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    c.execute(registry.ORACLES["h2_dedup_runs"])
    df = registry.QUERIES["h2_dedup_runs"](spark, str(tmp_path))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of([d[0] for d in c.description], c.fetchall()) and len(got[1]) == 13


def test_sentences_are_chosen_alike_in_arrow_batches_and_by_columns(spark):
    texts = [None, "", " ", "One. Two two! Three three three?\nÉté ÉTÉ naïve x_y 12½ Ⅷ 中文。", "the and of. is. are!", "a.b.c\n\n\n...", "tab\there\vand\x85there end.  x.", "w " * 16384 + ".", " ".join(f"Topic{i % 9} says {i} things of word{i % 4}, and topic{i % 5}." for i in range(200))]
    d = spark.createDataFrame([(i, t, k) for i, t in enumerate(texts) for k in (1, 32, 300)], "id int, t string, k long")
    d = text.with_extract(d, F.col("k"), "t").withColumn("s", text.sentences(F.col("t")))
    got = d.withColumn("arrow", F.arrow_udf(text.chosen, "array<string>")("s", "k")).collect()
    assert len(got) == 27 and all((r.arrow or []) == (r._picks or []) for r in got), [r for r in got if r.arrow != r._picks][:1]
    for x in (0.0078125, 1.0000005, 2.5000005, 12345.6789015, 7 / 3**0.5):
        want = spark.range(1).select(F.round(F.lit(x), 6)).first()[0]
        assert text._millionths(x) / 1e6 == want
