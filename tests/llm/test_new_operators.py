"""Periodic runs, whitening and exact dedup against brute force, on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from mnemoq.llm import exact_dedup, periodic_runs, whitening
from tests.conftest import SMALL

DOCS = "doc_id long, text string, start string, n_chars long"


def all_runs(w, least=12):
    """(start, length, period) of each run, by its definition."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, 2 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_automaton_finds_all_runs():
    r = random.Random(7)
    for _ in range(1500):
        w = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.5:
            a, p = r.randrange(len(w)), r.randint(1, 9)
            w = w[:a] + [w[a + (i - a) % min(p, len(w) - a)] for i in range(a, len(w))]
        least = r.choice([1, 2, 5, 12])
        assert periodic_runs.runs_of(w, least) == all_runs(w, least)


def test_automaton_on_words_with_many_squares():
    fib = [0], [0, 1]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    thue = [bin(i).count("1") % 2 for i in range(256)]
    for w in (fib[1][:300], thue, [0] * 300, ([0] * 7 + [1]) * 30):
        assert periodic_runs.runs_of(w, 2) == all_runs(w, 2)


def test_stretches_hold_every_run():
    r = random.Random(3)
    for _ in range(400):
        docs = [[r.randrange(r.choice([2, 4, 60])) for _ in range(r.randint(0, 90))] for _ in range(4)]
        for d in docs:
            if d and r.random() < 0.5:
                a, p = r.randrange(len(d)), r.randint(1, 30)
                d[:] = d[:a] + [d[a + (i - a) % min(p, len(d) - a)] for i in range(a, len(d))]
        of = np.repeat(np.arange(4), [len(d) for d in docs])
        codes = np.array([x for d in docs for x in d], np.int32)
        got = [(int(b) + s, n, q) for b, e in zip(*periodic_runs.stretches(codes, of), strict=True) for s, n, q in periodic_runs.runs_of(codes[b:e].tolist())]
        base = np.cumsum([0] + [len(d) for d in docs])
        assert sorted(got) == sorted((int(base[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in all_runs(d))


def test_runs_of_strange_texts(spark):
    long = " ".join(f"w{i % 501}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 12), (4, "a " * 12), (5, "a " * 11), (None, "é\x85b c\x0b" * 9), (6, long), (7, "x y " * 10 + "z " + "p q r " * 9)]
    rows = [(i, t, "clash", None) for i, t in rows]
    out = periodic_runs.find(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert len(out) == len(rows)
    for r in out:
        w = words(r.text)
        runs = [(x.start, x.length, x.period) for x in r._pr_runs]
        assert r.start == "clash" and r._pr_words == len(w)
        assert runs == (all_runs(w) if len(w) < 1000 else [(0, 150_000, 501)])
        assert r._pr_text == collapsed(w, runs)
    left = periodic_runs.collapse(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "start", "n_chars"] and {r.text for r in left.collect()} >= {None, "", " \n\t ", "a", "a " * 11}
    assert periodic_runs.find(spark.createDataFrame([], DOCS)).count() == 0


def test_run_query_against_brute_force(spark):
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        h = zlib.crc32(str(r.doc_id).encode())
        g, w = h // 10, words(r.text)
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = periodic_runs.runs_of([ids[x] for x in w]) if len(w) > 1500 else all_runs(w)  # the whole text, where brute force takes too long
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[r.doc_id] = (len(runs), *top, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest())
    got = periodic_runs.op11_periodic_runs(spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and sum(v[0] for v in want.values()) > 10


VECTORS = "vec_id long, embedding array<double>, component string"


def test_whitening_against_eigenvectors(spark):
    out = whitening.op12_whitening(spark, SMALL).toPandas()
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas()
    x = np.floor(np.stack(e.embedding).astype(float) * 256)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9) and len(out) == 4 * len(e)
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-9)
    one = out[out.component == 1].set_index("vec_id")
    assert [int(v) for v in ((n * x - s) ** 2).sum(axis=1)] == one.deviation.loc[e.vec_id].tolist() and set(out.n) == {n}
    assert np.allclose(out.groupby("component").explained.first(), values[:4] / values.sum()) and out.identity_error.max() < 1e-10


def test_whitening_of_ill_conditioned_rows(spark):
    r = np.random.default_rng(5)
    b = r.normal(size=(300, 8)) @ np.diag(10.0 ** -np.arange(8)) @ r.normal(size=(8, 8)) * 1e6
    df = spark.createDataFrame([(i, row.tolist(), "e") for i, row in enumerate(b)], VECTORS).repartition(3)
    out, model = whitening.whiten(df, "embedding", components=8)
    x = np.floor(b * 256)
    s = np.linalg.svd(x - x.mean(axis=0))[1]
    assert model.passes >= 2 and np.allclose(model.eigenvalues, s**2 / 300, rtol=1e-6) and model.identity_error < 1e-4
    assert out.columns == ["vec_id", "embedding", "component", "_wh_white", "_wh_deviation"]


def test_whitening_of_strange_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0, None, 2.0]), (4, [1.0, -inf, 2.0]), (5, [nan, 1.0, 1.0]), (6, []), (7, [1.0, 2.0]),
            (8, [2.0, 4.0, 6.0]), (9, [3.0, 6.5, 9.0]), (9, [3.0, 6.5, 9.0]), (None, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(i, v, "e") for i, v in rows], VECTORS)
    out, model = whitening.whiten(df, "embedding")
    got = out.collect()
    assert sorted(r.vec_id or 0 for r in got) == [0, 1, 8, 9, 9] and model.n == 4 and model.dims == 3
    assert all(r._wh_white[2] is None and None not in r._wh_white[:2] for r in got)  # three vectors in a plane
    same, flat = whitening.whiten(df.where("vec_id = 9"), "embedding")
    assert flat.n == 1 and flat.identity_error is None and flat.explained() == [None] * 3
    assert [(r._wh_white, r._wh_deviation) for r in same.collect()] == [([None] * 3, 0)] * 2
    empty, none = whitening.whiten(df.where("vec_id = 2"), "embedding")
    assert empty.count() == 0 and none.n == 0
    far, model = whitening.whiten(spark.createDataFrame([(1, [1e12, 1.0], "e"), (2, [-1e12, 3.0], "e"), (3, [1e300, 0.0], "e")], VECTORS), "embedding")
    assert {r.vec_id: r._wh_deviation for r in far.collect()} == {1: None, 2: None, 3: None} and model.dims == 2  # beyond a long
    with pytest.raises(ValueError, match="max_dims"):
        whitening.usable(df, "embedding", max_dims=2)


def test_triangular_solves_and_shifted_factors():
    r = np.random.default_rng(1)
    a = np.triu(r.normal(size=(70, 70))) + 9 * np.eye(70)
    rows = r.normal(size=(5, 70))
    assert np.allclose(whitening.solved(rows, a) @ a, rows)
    g = np.ones((4, 4))  # of rank one
    f = whitening.factored(g, 0.0)
    assert np.allclose(f.T @ f, g, atol=1e-10) and np.allclose(np.tril(f, -1), 0)


def exact(rows):
    groups = defaultdict(list)
    for at, (d, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, at))
    out = []
    for t, members in groups.items():
        best = min(members)
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), m is best, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def test_exact_dedup_against_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \n", "é a", "éa ", "\x85a", "A", "a", "x" * 300_000, " ".join("x" * 300_000)] + [" ".join(str(r.randrange(9)) for _ in range(40)) for _ in range(150)]
    rows = [(r.choice([None, *range(400)]), r.choice(texts) if k % 3 else "one of a third", "e", k) for k in range(900)]
    docs = spark.createDataFrame([(d, t, e, k) for d, t, e, k in rows], DOCS).repartition(5).cache()
    rows = [(x.doc_id, x.text, x.start, x.n_chars) for x in docs.collect()]
    want = exact(rows)
    # as it is; keys of five bits, so that chains are long; a directory of one bit; a map that is full; one class broadcast
    for how in ({}, {"key_bits": 5, "capacity": 1}, {"max_depth": 1, "capacity": 4}, {"max_bits": 10, "capacity": 3}, {"max_broadcast": 1}):
        got = exact_dedup.classes(docs, **how).collect()
        same = sorted(((x._xd_id, x._xd_keep_id, x._xd_size, x._xd_kept, x._xd_sha.hex()) for x in got), key=str)
        assert [v[:3] + v[4:] for v in same] == [v[:3] + v[4:] for v in want], how
        kept = [x for x in got if x._xd_kept]
        assert len(kept) == len({x._xd_sha for x in got}) and all(x._xd_id == x._xd_keep_id for x in kept)
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns and left.count() == len({v[4] for v in want})
    docs.unpersist()
    assert exact_dedup.classes(spark.createDataFrame([], DOCS)).count() == 0
    words_ = spark.createDataFrame([("b", "t", "e", 1), ("a", "t ", "e", 1), (None, " t", "e", 1)], "doc_id string, text string, start string, n_chars long")
    assert {(x._xd_id, x._xd_keep_id, x._xd_size, x._xd_kept) for x in exact_dedup.classes(words_).collect()} == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False)}


def test_directory_doubles_and_splits():
    r = np.random.default_rng(2)
    keys = r.integers(-(2**63), 2**63 - 1, 5000)
    keys[:3000] = (keys[:3000].view(np.uint64) >> np.uint64(9)).view(np.int64)  # crowded below
    d = exact_dedup.Directory()
    bits = 16
    cells = np.bincount((keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    assert d.insert(cells, bits, 50) == []
    b = d.bucket_of(keys)
    assert np.bincount(b).max() <= 50 and len(d.slots) == 1 << d.depth and d.depth <= bits and len(set(d.bits)) > 2
    for k in range(len(d.bits)):  # every bucket is a range, of as many slots as its bits leave
        at = np.flatnonzero(d.slots == k)
        assert len(at) == 1 << (d.depth - d.bits[k]) and at[-1] - at[0] + 1 == len(at)
    assert sorted(set(b[np.argsort(keys.view(np.uint64))].tolist())) == sorted(set(b.tolist()))


def test_index_lies_in_shared_files(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40}", "e", 1) for i in range(100)], DOCS)
    base = exact_dedup.numbered(docs, "_xd_row").selectExpr("_xd_row", "doc_id AS _xd_id", "text AS _xd_text")
    index = exact_dedup.build(base, capacity=4)
    slots = {r.slot: (r.bucket, r.bits) for r in spark.read.parquet(f"{index.path}/directory").collect()}
    entries = index.buckets.collect()
    assert len(entries) == 40 and sum(r.size for r in entries) == 100 and len(slots) == 1 << index.directory.depth
    assert all(slots[(r.key % 2**64) >> (64 - index.directory.depth)][0] == r.bucket for r in entries)
    assert all(sum(r.bucket == b for r in entries) <= 4 for b, _ in slots.values())


def test_many_small_tiles_go_through_arrow_together_and_none_is_lost(spark):
    import numpy as np

    from mnemoq.llm import near_dedup as nd

    rng, docs, tiles = np.random.default_rng(3), [], []
    for tile, m in enumerate([2, 3, 1, 47, 48, 49, 120, *rng.integers(1, 6, 400).tolist()]):
        base = np.sort(rng.integers(1, 2**31, nd.K + 40))
        for k in range(m):
            own = np.sort(rng.permutation(base)[: nd.K]) if k % 3 else np.sort(rng.integers(1, 2**31, nd.K))
            doc = len(docs)
            docs.append((doc, [tile % 50, 1000 + tile, *([tile % 50 - 1] if k % 4 == 0 else [])], 400 if k % 5 else 100, own.astype("<u4").tobytes()))
            tiles.append((tile % 50, tile % 2, 0, tile // 50, doc, doc - k % 2))
    dealt = spark.createDataFrame(tiles, "value long, kind int, i int, j int, doc_id long, component long").repartition(7)
    listed = spark.createDataFrame(docs, "doc_id long, values array<long>, n long, sketch binary")
    out = nd.promising(dealt, listed, 75)
    got = {(r.value, r.kind, r.i, r.j, r.doc_id) for r in out.collect()}
    want, of, by = set(), {d[0]: d for d in docs}, {}
    for t in tiles:
        by.setdefault(t[:4], []).append(t)
    sk = {d[0]: nd._padded([d[3]]) for d in docs}
    for key, rows in by.items():
        for a in rows:
            for b in rows:
                x, y = of[a[4]], of[b[4]]
                if a[5] != b[5] and 100 * min(x[2], y[2]) >= 75 * max(x[2], y[2]) and min(set(x[1]) & set(y[1])) == key[0] and nd.similar(sk[x[0]], sk[y[0]])[0] >= nd.ESTIMATE:
                    want |= {(*key, a[4]), (*key, b[4])}
    assert got == want and 100 < len(want) < len(tiles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan
