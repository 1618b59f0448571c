"""The pipeline against all five of its rules in plain Python, on documents where every stage has work to do."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.test_llm import components, dropped_lines, ids_of, text

pipeline = pytest.importorskip("corpus_pipeline")
from mnemoq.llm import packing, quality  # noqa: E402

SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string, sequence_id long, kept boolean"
LINE = "this very line of well over forty characters is shared by many"
PASSAGE = text(77, 30)


def documents():
    """Clean texts, near copies, shared lines, a benchmark's passage, texts that the rules reject, and strange rows."""
    r, out = random.Random(5), []
    for g in range(6):
        base = text(300 + g, 150).split()
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[r.randrange(150)] = "changed"
            out.append(" ".join(w))
    out += [f"{text(400 + i, 60)}\n  {LINE.upper() if i % 2 else LINE} \n{text(450 + i, 60)}" for i in range(7)]
    out += [f"{text(500 + i, 90)} {PASSAGE.upper() if i % 2 else PASSAGE} {text(550 + i, 90)}" for i in range(4)]
    out += [f"{text(560, 900)} {PASSAGE} {text(561, 900)}", "short one", None, "", " \n\t ", "again and " * 60, text(600, 3000), "x" * 5000 + " " + text(601, 70)]
    out += [" ".join(f"bad{r.randrange(40)}" for _ in range(120)) for _ in range(12)]
    # what lost a shared line is then a near copy of what never had it
    out += [f"{text(700, 80)}\n{LINE}", text(700, 80)]
    return [(i * 3, t, f"s{i % 2}", 7, None) for i, t in enumerate(out)] + [(1000, text(800, 90), "s", 7, False)] * 2


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def grams(t):
    """Buckets of a text's words and pairs; the hash of a pair goes on from its first word's."""
    w = [x.encode() for x in re.findall(SPACE, t or "")]
    first = [xxhash.xxh64_intdigest(x, 42) for x in w]
    return [h % 8192 for h in first] + [xxhash.xxh64_intdigest(b, h) % 8192 for h, b in zip(first, w[1:])]


def plain(rows, trusted, bench):
    """(doc_id, text) of what the first four stages leave."""
    raw, good = Counter(), Counter()
    for d, t, *_ in rows:
        raw.update(grams(t))
        good.update(grams(t) if d in trusted else [])
    n, m = sum(raw.values()) + 4096, sum(good.values()) + 4096
    score = lambda g: round(1000 * (math.log((good[g] + 0.5) / m) - math.log((raw[g] + 0.5) / n)))
    stages, left = [], []
    for row in rows:
        w, g = re.findall(SPACE, row[1] or ""), grams(row[1])
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and sum(map(score, g)) >= quality.THRESHOLD * len(g):
            left.append((row[0], row[1]))
    stages.append(left)
    left = [(d, t) for d, _, _, t in dropped_lines(left)]
    stages.append(left)
    sets = {}
    for d, t in left:
        w = re.findall(SPACE, lower(t))
        sets[d] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    own = components(sets)
    left = [(d, t) for d, t in left if own[d] == d]
    stages.append(left)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for b in bench:
        w = re.findall(word, lower(b))
        windows |= {tuple(w[k : k + 13]) for k in range(max(len(w) - 12, 1))} if w else set()
    clean = []
    for d, t in left:
        w, hit = re.findall(word, lower(t)), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                hit |= set(range(k, k + size)) if tuple(w[k : k + size]) in windows else set()
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((d, t))
    return [*stages, clean]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = documents()
    base = tmp_path_factory.mktemp("corpus")
    trusted = {d for d, t, *_ in rows if t and "bad" not in t and d % 2 == 0}
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in trusted] + [(d, 0, 0) for d, *_ in rows if d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows, trusted


def test_every_stage_against_plain_python(spark, folder):
    base, rows, trusted = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, seen = docs.columns, len(rows)
    for (name, stage), want in zip(pipeline.STAGES[:-1], plain(rows, trusted, [PASSAGE])):
        docs = stage(spark, docs, base)
        assert docs.columns == columns, name
        kept = docs.collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted(want), name
        assert name == "line dedup" or len(kept) < seen, name
        assert all(r.sequence_id == 7 for r in kept)
        seen = len(kept)
        docs = spark.createDataFrame(kept, DOCS)


def test_run_packs_what_the_rules_leave(spark, folder):
    base, rows, trusted = folder
    want = Counter(d for d, _ in plain(rows, trusted, [PASSAGE])[-1])
    texts = dict(plain(rows, trusted, [PASSAGE])[-1])
    out = pipeline.run(spark, base).collect()
    assert {r.doc_id for r in out} == set(want)
    whole, places = {}, {}
    for r in out:
        whole.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, n in want.items():
        ids = np.array([*ids_of(texts[d]), 0], "<u4")
        assert sum(r.length for r in whole[d]) == n * len(ids)
        for r in whole[d]:
            assert n > 1 or r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for at in places.values():
        at = sorted(at)
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= packing.SIZE


def test_empty_tables_give_no_rows(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
