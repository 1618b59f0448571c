"""Binary symbol indexes, merges, manifests, build graphs and module listings."""

import pytest
from pyspark.sql import functions as F

from mnemoq.operators import graph
from mnemoq.sources import symbol_index as ix


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def symbol(name, kind=0, shown="", signature="", related=()):
    out = field(1, name) + b"".join(field(4, r) for r in related) + field(5, kind) + field(6, shown)
    return out + (field(7, field(4, "lang") + field(5, signature)) if signature else b"")


def occurrence(name, span, roles):
    return field(1, b"".join(map(varint, span))) + field(2, name) + field(3, roles)


def document(path, symbols=(), occurrences=()):
    return field(2, field(1, path) + b"".join(field(3, s) for s in symbols) + b"".join(field(2, o) for o in occurrences))


def files(spark, **parts):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in parts.items()], "part string, content binary")


HAND = bytes.fromhex("12170a01611a0e0a0162280f32036f6e653a022a007212020000")  # no index: the second length reaches beyond the document


def test_decodes_every_field(spark):
    related = field(1, "base") + field(3, 1)
    doc = document("src/a.x", [symbol("s a", 17, "a", "fn a()", [related, field(2, 1)]), symbol("", 17), symbol("s b", 99)],
                   [occurrence("s a", [300, 0, 70000], 1), field(1, 5) + field(1, 6) + field(1, 9) + field(2, "s b") + field(3, 2**64 - 1), occurrence("", [1], 1)])
    data = field(1, b"\x08\x01") + doc + varint(9 << 3 | 5) + b"1234" + varint(8 << 3 | 1) + b"12345678" + field(3, symbol("ext", 7))
    got = ix.decode(files(spark, p=data)).orderBy("doc").collect()
    assert [r.relative_path for r in got] == ["src/a.x", None] and got[1].symbols[0].kind == "Class"
    a, b = got[0].symbols
    assert (a.symbol, a.display_name, a.kind, a.signature) == ("s a", "a", "Function", "fn a()") and b.kind is None and b.signature is None
    assert [tuple(r) for r in a.relationships] == [("base", True, False)]
    assert [tuple(o) for o in got[0].occurrences] == [("s a", [300, 0, 70000], 1), ("s b", [5, 6, 9], -1)]


@pytest.mark.parametrize("bad", [HAND, b"\x12\xff", b"\xff" * 11, field(2, b"\x0a\x02\xff\xfe"), field(2, 5), varint(2 << 3 | 3), b"\x02\x00"])
def test_broken_file_is_one_row_and_others_load(spark, bad):
    good = document("a", [symbol("s a", 17)])
    got = ix.decode(files(spark, x=good + bad, y=good, z=b"", n=None)).collect()
    assert sorted((r.part, r.relative_path, r.error is None) for r in got) == [("x", None, False), ("y", "a", True)]
    docs, ext, status = ix.merge(ix.decode(files(spark, x=good + bad, y=good)))
    assert docs.count() == 1 and ext.count() == 0 and {(r.part, r.documents, r.error is None) for r in status.collect()} == {("x", 0, False), ("y", 1, True)}


def test_documents_in_batches_keep_their_order(spark):
    got = ix.decode(files(spark, p=b"".join(document(f"d{i}") for i in range(25))), rows=4).orderBy("doc").collect()
    assert [(r.doc, r.relative_path) for r in got] == [(i, f"d{i}") for i in range(25)]


def test_definitions_beat_externals_and_the_latest_beats_older_ones(spark):
    use = lambda *names: [occurrence("s main", [0, 0, 1], 1), *[occurrence(n, [i + 1, 0, 1], 0) for i, n in enumerate(names)]]
    one = document("main", [symbol("s main", 17, "main")], use("s t", "s twice", "s late", "s none#")) + field(3, symbol("s t", 17)) + field(3, symbol("s twice", 7)) + field(3, symbol("s twice", 17))
    two = document("t", [symbol("s t", 49, "first", "sig")], [occurrence("s t", [4, 0, 1], 1)]) + document("late", [symbol("s late", 17)])
    three = document("late", [symbol("s late", 0)]) + document("u", [symbol("s t", 49, "second")])
    docs, ext, _ = ix.merge(ix.decode(files(spark, p1=one, p2=two, p3=three)), spark.createDataFrame([("p1", "."[:0]), ("p2", "m2/"), ("p3", "m3")], "part string, root string"))
    ent, rel = graph.load(docs, "/p", ext)
    assert {(r.dst, r.kind) for r in rel.collect()} == {("s t", "REFERENCES"), ("s twice", "REFERENCES"), ("s none#", "REFERENCES")}
    got = {r.id: r for r in ent.collect()}
    assert len(got) == ent.count() == 5
    t = got["s t"]
    assert (t.name, t.file_path, t.line_range, t.signature) == ("first", "m3/u", "5:5", "sig") and got["s main"].file_path == "main" and got["s none#"].file_path is None


def test_rebase_twice_changes_nothing_more(spark):
    rows = spark.createDataFrame([("a.x", "m"), ("m/a.x", "m"), ("m", "m"), ("mm/a", "m/"), ("a", ""), ("a", None), (None, "m")], "path string, root string")
    once = rows.withColumn("path", ix.rebase(F.col("path"), F.col("root")))
    want = ["m/a.x", "m/a.x", "m", "m/mm/a", "a", "a", None]
    assert [r.path for r in once.collect()] == want
    assert [r.path for r in once.withColumn("path", ix.rebase(F.col("path"), F.col("root"))).collect()] == want


def test_manifest_lines(spark):
    rows = [(1, "# no"), (2, "  "), (3, ".\ta.index"), (4, "m/x\t /abs/b "), (5, "no tab"), (6, "m\t "), (7, "\tc"), (8, None)]
    got = [tuple(r) for r in ix.manifest(spark.createDataFrame(rows, "line long, value string")).orderBy("line").collect()]
    assert got == [(3, "", "a.index", None), (4, "m/x", "/abs/b", None), (5, None, None, "no tab"), (6, None, None, "no tab"), (7, None, None, "no tab")]


def test_one_corrupt_build_graph_among_ten(spark):
    rule = lambda n: f'{{"type":"RULE","rule":{{"name":"//a:{n}","ruleClass":"r","location":"/w/BUILD:3:1","ruleInput":["//a:0"]}},"more":1}}'
    rows = [(f"p{p}", v) for p in range(10) for v in (rule(p), rule(p + 100), '{"type":"SOURCE_FILE","sourceFile":{"name":"x"}}', " ")] + [("p4", '{"type":"RU')]
    rules, status = ix.build_graph(spark.createDataFrame(rows, "project string, value string"))
    assert rules.count() == 18 and rules.where("project = 'p4'").count() == 0
    got = {r.project: tuple(r)[1:] for r in status.collect()}
    assert got.pop("p4") == (0, 1, False) and set(got.values()) == {(2, 0, True)} and len(got) == 9
    empty, none = ix.build_graph(spark.createDataFrame([], "project string, value string"))
    assert empty.count() == none.count() == 0


def test_targets_are_relative_to_the_root(spark):
    rows = [("p", "//a/b:c", "/w/p/a/BUILD:7:2"), ("p", "//a/b", "/other/BUILD:1:1"), ("p", "c:d:e", "C:\\x:9:1"), ("p", "n", "")]
    got = graph.target_rows(spark.createDataFrame(rows, "project string, name string, location string"), "/w/p").collect()
    assert [(r.name, r.file_path, r.line_range) for r in got] == [("c", "a/BUILD", "7:7"), ("b", "/other/BUILD", "1:1"), ("e", "C:\\x", "9:9"), ("n", None, None)]


def test_modules_skip_pruned_folders_and_links(spark):
    rows = [("r", p, False) for p in ("go.mod", "a/go.mod", "a/b/go.mod", "vendor/x/go.mod", ".git/go.mod", "a/testdata/go.mod", "out/k/go.mod", "a/main.go")] + [("r", "out", True), ("q", "out/go.mod", None)]
    got = {tuple(r) for r in ix.modules(spark.createDataFrame(rows, "repo string, path string, is_link boolean")).collect()}
    assert got == {("r", ""), ("r", "a"), ("r", "a/b"), ("q", "out")}


def test_label_count(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a\n\n \u3000\nb\n",)], "t string")
    assert [r[0] for r in rows.select(ix.label_count(F.col("t"))).collect()] == [0, 0, 2]
