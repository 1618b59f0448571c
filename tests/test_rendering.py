"""Rendered neighbourhoods against a plain version, byte caps, read contexts and spared reads."""

import pytest
from pyspark.sql import functions as F

from mnemoq.operators import rendering

ENTITY = "id string, name string, project string, file_path string, line_range string, signature string"
RELATION = "id string, src string, dst string, kind string, closed boolean"
ROWS = [("e_foo", "foo", "/p", "src/lib.rs", "10:20", "fn foo() -> i32"), ("e_bar", "bar", "/p", "src/lib.rs", "30:35", None), ("e_far", "far", "/w/other/", "x.rs", "3:4", ""),
        ("e_dup1", "dup", "/p", "a.rs", None, None), ("e_dup2", "dup", "/p", None, None, None), ("e_none", "", "/p", "src/lib.rs", "1:1", None), ("lone", "lone", None, None, None, None)]
EDGES = [("1", "e_foo", "e_bar", "CALLS", False), ("2", "e_foo", "e_bar", "CALLS", False), ("3", "e_foo", "e_far", "EXTENDS", False), ("4", "e_foo", "e_far", "IMPORTS", False), ("5", "e_foo", "e_dup1", "BAZEL_DEPENDS_ON", False),
         ("6", "e_bar", "e_foo", "CALLS", False), ("7", "e_far", "e_foo", "CALLS", True), ("8", "e_foo", "e_none", "CALLS", False), ("9", "e_bar", "e_foo", "REFERENCES", False)]


@pytest.mark.parametrize("most", range(0, 14))
def test_cut_keeps_whole_characters(spark, most):
    text = "aé…😀b́z"
    want = text.encode()[:most].decode(errors="ignore")
    assert spark.range(1).select(rendering.cut_bytes(F.lit(text), F.lit(most))).first()[0] == want


def test_cap_marks_the_part_that_goes_over_it_and_no_other(spark):
    def plain(parts, cap):
        out = ""
        for part in parts:
            room = cap - len(out.encode())
            if part is not None and room > 0:
                out += part if len(part.encode()) <= room else part.encode()[:room].decode(errors="ignore") + rendering.CUT
        return out

    parts = [["héad\n", None, "12345", "…x"], ["abcd", "e"], [""], []]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, p array<string>")
    for cap in (1, 2, 4, 6, 11, 12, 14, 100):
        assert [r[1] for r in rows.select("i", rendering.capped(F.col("p"), cap)).orderBy("i").collect()] == [plain(p, cap) for p in parts], cap


def test_markdown_of_every_case(spark):
    asked = spark.createDataFrame([(s,) for s in ("foo", "e_bar", "dup", "nothing", "lone", None, "foo")], "symbol string")
    got = {r.symbol: r.markdown for r in rendering.markdown(asked, spark.createDataFrame(EDGES, RELATION), spark.createDataFrame(ROWS, ENTITY)).collect()}
    assert got == {
        "foo": "## Symbol `foo` (defined in src/lib.rs:10)\n```\nfn foo() -> i32\n```\n**Calls**: `bar` (src/lib.rs:30)\n**References**: `far` (repo:other :: x.rs:3)\n**Bazel deps**: `dup` (a.rs)\n"
               "**Called by**: `bar` (src/lib.rs:30)\n**Sibling symbols** (same file): `bar`\n**Imports**: `far`\n",
        "e_bar": "## Symbol `bar` (defined in src/lib.rs:30)\n**Calls**: `foo` (src/lib.rs:10)\n**References**: `foo` (src/lib.rs:10)\n**Called by**: `foo` (src/lib.rs:10)\n**Sibling symbols** (same file): `foo`\n",
        "dup": "## Multiple matches\n- `dup` (a.rs)\n- `dup` (?)\n", "nothing": "No symbols matched.\n", "lone": "## Symbol `lone` (defined in ?)\n"}


def test_a_hub_shows_its_share(spark):
    ents = [("hub", "hub", "/p", "f", "1:1", None)] + [(f"n{i:03}", f"n{i:03}", "/p", "g", f"{i}:{i}", None) for i in range(200)]
    rel = [(f"o{i:03}", "hub", f"n{i:03}", "CALLS", False) for i in range(3)] + [(f"i{i:03}", f"n{i:03}", "hub", "CALLS", False) for i in range(200)]
    e, r = spark.createDataFrame(ents, ENTITY), spark.createDataFrame(rel, RELATION)
    found = rendering.resolved(spark.createDataFrame([("hub",)], "symbol string"), e)
    rows = rendering.neighbours(found, r, e, 30)
    assert {x.direction: x["count"] for x in rows.groupBy("direction").count().collect()} == {"out": 3, "in": 27}
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString()


def test_contexts_stay_within_their_bytes(spark):
    ents = [(f"e{i}", "n" * i, "/p", "f.rs", f"{i}:{i}", "s" * 50) for i in range(40)] + [("x", "x", "/p", "g.rs", None, None)]
    got = {r.path: r.context for r in rendering.read_context(spark.createDataFrame([("f.rs",), ("g.rs",), ("h.rs",), (None,)], "path string"), spark.createDataFrame(ents, ENTITY)).collect()}
    assert set(got) == {"f.rs", "g.rs"} and got["g.rs"].endswith("- `x` @ ?\n")
    assert got["f.rs"].endswith(rendering.CONTEXT_CUT) and 2040 <= len(got["f.rs"].encode()) <= 2048


def test_spared_reads_prefer_the_root(spark):
    asked = spark.createDataFrame([("foo",), ("far",), ("dup",), ("lone",)], "symbol string")
    files = spark.createDataFrame([("/p", "src/lib.rs", "a b c"), ("/here", "src/lib.rs", "a b"), ("/w/other/", "x.rs", None)], "project string, path string, text string")
    ents = spark.createDataFrame(ROWS, ENTITY)
    count = lambda root: {r.symbol: r.tokens for r in rendering.avoided_reads(asked, ents, files, root).collect()}
    assert count(None) == {"foo": 3, "far": 0, "dup": 0, "lone": 0} and count("/here")["foo"] == 2


def _most_rows(plan) -> int:
    """The greatest number of rows that any node of a plan has made."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _most_rows(plan.executedPlan())
    own = plan.metrics().get("numOutputRows")
    below = [plan.children().apply(i) for i in range(plan.children().size())] + ([plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [])
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, below)])


def test_rows_follow_the_symbols_of_a_file_and_not_their_square(spark):
    ents = [(f"e{i:04}", f"n{i:04}" if i % 50 else "", "/p", "big.rs", None if i == 7 else f"{i % 300}:9", "s") for i in range(1200)] + [("u", "u", "/p", None, "1:1", None)]
    rel = [(f"x{i}", f"e{i:04}", f"e{(i * 7) % 1200:04}", "CALLS", i % 5 == 0) for i in range(1200)]
    got = rendering.markdown(spark.createDataFrame([(e[0],) for e in ents], "symbol string"), spark.createDataFrame(rel, RELATION), spark.createDataFrame(ents, ENTITY))
    rows, order = got.collect(), sorted(ents[:-1], key=lambda e: (e[4] or "", e[0]))
    for r in rows:
        want = [f"`{e[1]}`" for e in [e for e in order if e[0] != r.symbol][:10] if e[1]] if r.symbol != "u" else []
        line = [x for x in r.markdown.split("\n") if x.startswith(rendering.SAME_FILE)]
        assert r.n == 1 and line == [rendering.SAME_FILE + ", ".join(want)] * bool(want), r
    assert len(rows) == 1201 and _most_rows(got._jdf.queryExecution().executedPlan()) < 50_000


def test_a_bitmap_keeps_all_that_is_asked_for(spark):
    keys, rows = spark.range(0, 100_000, 7).selectExpr("concat('k', id) as id"), spark.range(100_000).selectExpr("concat('k', id) as x", "id as n")
    kept = {r.n for r in rendering.likely(rows, "x", keys).collect()}
    assert set(range(0, 100_000, 7)) <= kept and len(kept) < 15_000
    assert rendering.likely(rows, "x", keys.where("false")).count() == 0
