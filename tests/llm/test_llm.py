"""The ten operators and the pipeline against brute force and planted cases, on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoq.llm import chat, decontaminate, huffman_files, line_dedup, lm_score, near_dedup, packing, pii, quality, url_filter
from mnemoq.llm.tokens import default_path, encoder

WORDS = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string, extra string, n_chars long"


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = text(1, 120)
    near = base.split()
    near[60] = "changed"
    line = "a line of more than forty characters that is shared"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n \t "), (7, "Word"), (8, "A b\r\nc d é É"), (9, text(2, 4000))]
    out += [(10 + i, text(10 + i) + f"\n  {line.upper() if i % 2 else line}\t\n" + text(50 + i)) for i in range(6)]
    out += [(20, "x " * 100), (21, text(3) + " " + text(4, 60)), (21, text(3) + " " + text(4, 60))]
    return [(i, t, "e", len(t) if t is not None else None) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_decontamination_against_brute_force(spark, docs, rows, none, monkeypatch):
    passage = " ".join(text(4, 60).split()[10:40])
    bench = spark.createDataFrame([(1, passage), (2, "Word"), (3, None), (4, "  "), (10, passage.upper())], "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in ((1, passage), (2, "Word"), (10, passage.upper())):
        w = words(t)
        for k in range(max(len(w) - 12, 1)):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = []
    for d, t, *_ in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items |= grams[tuple(w[k : k + n])]
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for most in (50_000, 1):  # the set sent with the plan, and the maps beyond its bound
        assert sorted(map(tuple, decontaminate.report(docs, bench, max_set=most).collect())) == sorted(want)
    monkeypatch.setattr(decontaminate._hits_by_map, "__defaults__", (8,))  # maps so small that nearly all passes them
    assert sorted(map(tuple, decontaminate.report(docs, bench, max_set=1).collect())) == sorted(want)
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not w[5] for w in want)
    assert decontaminate.report(decontaminate.remove_spans(docs, bench), bench).where("n_hit > 0").count() == 0
    assert decontaminate.remove_documents(docs, bench.where("false")).count() == len(rows)
    assert decontaminate.report(none, bench).count() == 0


def test_quality_counts_and_verdicts(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 9, 10, 11, 12, 13, 14, 15)] + [(20, 0, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    scores = quality.fit(docs, labels)
    out = quality.judge(docs, scores).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.text): r for r in out}
    # the hash function is Spark's; buckets, counts and logs are made here
    split = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    known = sorted({(a, b) for w in split.values() for a, b in zip(w, [*w[1:], None])}, key=str)
    hashes = spark.createDataFrame(known, "a string, b string").selectExpr("a", "b", "pmod(xxhash64(a), 8192) h", "pmod(xxhash64(a, b), 8192) hh").collect()
    one, two = {x.a: x.h for x in hashes}, {(x.a, x.b): x.hh for x in hashes}
    grams = {k: [one[x] for x in w] + [two[p] for p in zip(w, w[1:])] for k, w in split.items()}
    raw = Counter(g for d, t, *_ in rows for g in grams[(d, t)])
    good = Counter(g for d, t, *_ in rows if d in (1, 2, 3, 9, 10, 11, 12, 13, 14, 15) for g in grams[(d, t)])
    n, m = sum(raw.values()) + 4096, sum(good.values()) + 4096
    assert scores == [round(1000 * (math.log((good[g] + 0.5) / m) - math.log((raw[g] + 0.5) / n))) for g in range(8192)]
    for d, t, *_ in rows:
        r = by[(d, t)]
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r._q_base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        # the verdict: the table's scores of all words and pairs, by length
        own = [scores[g] for g in grams[(d, t)]]
        assert abs(r._q_llr - (sum(own) / len(own) if own else 0)) < 1e-9
        assert r._q_kept == (not r._q_base_failed and sum(own) >= quality.THRESHOLD * len(own))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 9}
    assert quality.keep_good(none, labels).count() == 0
    clash = docs.where("doc_id in (1, 9)").selectExpr("*", "777 as n_words", "'mine' as llr", "false as kept")
    assert {(r.n_words, r.llr, r.kept) for r in quality.keep_good(clash, labels).collect()} == {(777, "mine", False)}
    assert {(r.n_words, r.llr, r.kept) for r in quality.judge(clash, scores).collect()} == {(777, "mine", False)}
    assert not any(quality.fit(docs, labels.where("false")))


def test_pseudonyms_keep_format_and_links(spark):
    luhn = lambda x: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x[::-1])) % 10 == 0
    t = "card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; ssn 123-45-6789, 2024-02-29, 2024-02-30, +1 (017) 555-7713, 192.168.0.1. ab.34@mail7.example.com " + "0a" * 20
    d = spark.createDataFrame([(1, t, 0), (2, t, 0), (3, None, 0), (4, "plain", 0)], "doc_id long, text string, n_ips long")
    a, b, null, plain = sorted(pii.pseudonymise(d, "k").collect(), key=lambda r: r.doc_id)
    assert all(r.n_ips == 1 for r in (a, b)) and a.text == b.text and null.text is None and plain.text == "plain"
    assert (a.n_cards, a.n_ssns, a.n_dates, a.n_phones, a.n_ips, a.n_mails, a.n_secrets) == (2, 1, 1, 1, 1, 1, 1)
    for gone in ("4111 1111", "123-45-6789", "2024-02-29", "555-7713", "192.168.0.1", "ab.34@", "0a0a"):
        assert gone not in a.text
    assert "4111111111111112" in a.text and "2024-02-30" in a.text
    one, two = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", a.text).groups()
    assert one.replace(" ", "") == two and luhn(two)
    other = pii.pseudonymise(d, key="another").where("doc_id = 1").first().text
    assert other != a.text
    n = spark.range(1000).selectExpr(pii.feistel("id", 25, 40, "k", "t") + " as y").distinct()
    assert n.count() == 1000  # a permutation of its domain


def plain_pseudonyms(t, key):
    """The same by Python's own integers, hashes and dates, with regular expressions of the regex module."""
    import datetime

    import regex

    prf = lambda tag, *args: int(hashlib.sha256("|".join([key, tag, *map(str, args)]).encode()).hexdigest()[:15], 16)

    def feistel(x, left, right, tag):
        a, b = divmod(x, right)
        for r in range(1, pii.ROUNDS + 1):
            if r % 2 == 0:
                a = (a + prf(tag, r, b)) % left
            else:
                b = (b + prf(tag, r, a)) % right
        return a * right + b

    def walk(x, left, right, tag, ok):
        x = feistel(x, left, right, tag)
        while not ok(x):
            x = feistel(x, left, right, tag)
        return x

    def refill(m, digits):
        digits = iter(digits)
        return "".join(next(digits) if c in "0123456789" else c for c in m)

    luhn = lambda x: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(x[::-1])) % 10
    social = lambda y: y < 900000000 and y // 1000000 not in (0, 666) and y // 10000 % 100 > 0 and y % 10000 > 0
    first = datetime.date(1900, 1, 1)

    def one(m):
        kind, s = next((k, v) for k, v in m.groupdict().items() if v is not None)
        d = regex.sub("[^0-9]", "", s)
        if kind == "mail":
            return f"user{prf('mail', s.lower()) % 10**12:012d}"
        if kind == "card" and luhn(d) == 0:
            p = f"{feistel(int(d[:15]), 10**8, 10**7, 'card'):015d}" if len(d) == 16 else d[:2] + f"{feistel(int(d[2:14]), 10**6, 10**6, 'card15'):012d}"
            return refill(s, p + str((10 - luhn(p + "0")) % 10))
        if kind == "ssn" and social(int(d)):
            return refill(s, f"{walk(int(d), 10**5, 10**4, 'ssn', social):09d}")
        if kind == "phone":
            return refill(s, d[:-10] + f"{feistel(int(d[-10:]), 10**5, 10**5, 'phone'):010d}")
        if kind == "ip":
            v = feistel(int.from_bytes(bytes(map(int, s.split(".")))), 65536, 65536, "ip")
            return ".".join(map(str, v.to_bytes(4)))
        if kind == "date":
            try:
                days = (datetime.date.fromisoformat(s) - first).days
            except ValueError:
                return s
            return str(first + datetime.timedelta(walk(days, 271, 270, "date", lambda y: y < 73_049)))
        if kind == "secret":
            return hashlib.sha256(f"{key}|secret|{s.lower()}".encode()).hexdigest()[: len(s)]
        return s

    return regex.sub("|".join(f"(?P<{k}>{p})" for k, p in (("mail", pii.MAIL), ("card", pii.CARD), ("ssn", pii.SSN), ("phone", pii.PHONE), ("ip", pii.IPV4), ("date", pii.DATE), ("secret", pii.SECRET))), one, t, flags=regex.A)


def test_pseudonyms_against_plain_python(spark):
    """Random texts of values, whole and damaged, side by side; a very long text; repeated rows; no rows."""
    r = random.Random(6)

    def value():
        n = "".join(r.choice("0123456789") for _ in range(16))
        p = n[:15]
        k = str((10 - sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate((p + "0")[::-1])) % 10) % 10)
        return r.choice([p + k, f"{p[:4]}-{p[4:8]}-{p[8:12]}-{p[12:]}{k}", n, f"{n[:3]}-{n[3:5]}-{n[5:9]}", f"({n[:3]}) {n[3:6]}-{n[6:10]}", f"+{n[0]} {n[1:4]} {n[4:7]} {n[7:11]}", f"{n[:2]}.{n[2:4]}.{n[4]}.1",
                         f"{r.choice(['19', '20'])}{n[:2]}-{r.randrange(1, 13):02d}-{r.randrange(1, 32):02d}", f"a{n[:3]}.b@mail.example.com", n + "@x.org", hashlib.md5(n.encode()).hexdigest(), "378282246310005", "plain", "\u00e9t\u00e9"])

    texts = ["", "plain", *(r.choice([" ", ", ", "; "]).join(value() for _ in range(r.randrange(1, 9))) for _ in range(150)), " ".join(value() for _ in range(3000))]
    rows = [(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[5], 9)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, n_cards int")
    got = pii.pseudonymise(d, "k").collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((i, plain_pseudonyms(t, "k")) for i, t, _ in rows)
    assert sum(x.n_cards for x in got) > 50 and pii.pseudonymise(d.where("false"), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(d, "")


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark, none):
    r = random.Random(7)
    texts, k = {}, 0
    for g in range(4):
        base = text(100 + g, 90).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts[k] = " ".join(w)
            k += 1
    shared = text(999, 60)
    for _ in range(30):  # a passage in common, no more
        texts[k] = shared + " " + text(2000 + k, 70)
        k += 1
    texts |= {k: None, k + 1: " ", k + 2: "One two", k + 3: "one TWO", k + 4: "one two three four five"}
    d = spark.createDataFrame([(i, t, "e", 0) for i, t in texts.items()], DOCS).repartition(5)
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    want = components(sets)
    got = {x.doc_id: x for x in near_dedup.classes(d).collect()}
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}
    left = near_dedup.keep_first(d)
    assert left.columns == d.columns and {x.doc_id for x in left.collect()} == {i for i in texts if want[i] == i}
    assert near_dedup.classes(none).count() == 0


def test_near_duplicates_of_short_texts_against_all_pairs(spark):
    """Pairs of 15 to 40 shingles that no third text touches: by their prefixes alone, at and around the least similarity."""
    r, texts = random.Random(11), {}
    sizes = [(n, m) for n in range(15, 31) for m in range(n, 41) if 74 * m <= 100 * n] + [(24, 32)] * 40 + [(24, 31)] * 40 + [(23, 30)] * 40
    for k, (n, m) in enumerate(sizes):
        w = [f"p{k}x{i}" for i in range(m + 4)]
        at = r.randrange(m - n + 1)
        texts[2 * k], texts[2 * k + 1] = " ".join(w[at : at + n + 4]), " ".join(w)
    d = spark.createDataFrame([(i, t, "e", 0) for i, t in texts.items()], DOCS).repartition(5)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    want = components(sets)
    assert len(set(want.values())) < len(want)
    assert {x.doc_id: x.component_id for x in near_dedup.classes(d).collect()} == want


def test_full_sets_go_to_rows_with_a_partner_alone(spark):
    """Lists of a common passage have members in many components; of them only rows that may have a partner meet by full sets."""
    shared, texts = text(999, 40), {k: text(999, 40) + " " + text(3000 + k, 30) for k in range(40)}
    for k in range(40, 52, 2):  # pairs that share the passage, too
        w = text(5000 + k, 60)
        texts[k], texts[k + 1] = shared + " " + w, shared + " " + w + " more"
    d = spark.createDataFrame([(i, t, "e", 0) for i, t in texts.items()], DOCS).repartition(3)
    base = near_dedup.sketches(d, 5)
    reps = base.select("doc_id", "n", "low", "sketch").cache()
    listed = near_dedup.inverted(reps, 75).join(reps.select("doc_id", "n", "sketch"), "doc_id").cache()
    alone = spark.createDataFrame([], "doc_id long, component long")
    dealt = near_dedup.dealt_tiles(listed, alone).cache()
    found = near_dedup.promising(dealt, listed, 75)
    assert dealt.select("doc_id").distinct().count() > 40
    assert {r.doc_id for r in found.collect()} == set(range(40, 52))
    sets = near_dedup._sets(d.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 5)
    links = near_dedup._tiles(listed, alone, sets, 75).collect()
    assert {frozenset((r.a, r.b)) for r in links} == {frozenset((k, k + 1)) for k in range(40, 52, 2)}


def dropped_lines(rows):
    """(doc_id, lines, dropped, text) by the rule alone."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(line_dedup.SPACE))
    holds = {}
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holds.setdefault(k, set()).add(d)
    want = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 40 and len(holds[key(x)]) >= 5 and max(i for i in holds[key(x)] if i is not None) != d)]
        want.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return want


def test_line_dedup_against_brute_force(docs, rows, none):
    want = dropped_lines(rows)
    for how in ({}, {"max_broadcast": 0}, {"max_broadcast": 1}, {"max_bits": 18}):
        got = [(r.doc_id, r._ld_lines, r._ld_dropped, r.text or "") for r in line_dedup.drop_lines(docs, **how).collect()]
        assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) == 5
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert line_dedup.drop_lines(none).count() == 0


def test_lines_of_equal_null_and_giant_documents(spark):
    """Rows of one doc_id are one document; a null doc_id is one, and keeps no line; a clash of names changes nothing."""
    one, two, three = (f"{n} is a line that is quite a bit longer than forty characters" for n in ("One", "\u00c9two", "three"))
    rows = [(1, one)] * 4 + [(2, one)] + [(i, two) for i in (1, 2, 3, None, None)] + [(i, f"x\n{three}\ny\n{three}") for i in range(5, 12)] + [(None, three), (50, "\n".join(f"{k} {three}" for k in range(20_000)))]
    rows = [(i, t, "mine", 7) for i, t in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_dropped long").repartition(3)
    for how in ({}, {"max_broadcast": 0}):
        got = [(r.doc_id, r._ld_lines, r._ld_dropped, r.text) for r in line_dedup.drop_lines(d, **how).collect()]
        assert sorted(got, key=str) == sorted(dropped_lines(rows), key=str)
    out = line_dedup.dedup(d)
    assert out.columns == d.columns and {(r.n_lines, r.n_dropped) for r in out.collect()} == {("mine", 7)}


def test_lines_of_documents_named_by_strings(spark):
    line = "a line of more than forty characters that is shared"
    rows = [(str(i), f"{i}\n{line}") for i in range(6)] + [("doc-a", line), (None, line)]
    d = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    for how in ({}, {"max_broadcast": 0}, {"max_bits": 18}):
        got = {r.doc_id: r._ld_dropped for r in line_dedup.drop_lines(d, **how).collect()}
        assert got == {d: int(d != "doc-a") for d, _ in rows}


def test_slices_send_one_map_at_a_time(spark, monkeypatch):
    rows = [(i, "\n".join(f"{j} is a line that is quite a bit longer than forty characters" for j in range(i % 7, 60))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 10)
    made, whole = [], line_dedup.suspects
    monkeypatch.setattr(line_dedup, "suspects", lambda *a: made.append(whole(*a)) or made[-1])
    got = [(r.doc_id, r._ld_lines, r._ld_dropped, r.text) for r in line_dedup.drop_lines(d, max_bits=14).collect()]
    assert sorted(got) == sorted(dropped_lines(rows)) and len(made) > 4
    assert all(sent._jbroadcast is None or not sent._jbroadcast.isValid() for _, sent in made)


def test_filters_send_few_lines_that_occur_once(spark):
    """At the size that follows the line count, suspects stay below twice the true repeats."""
    line = "{} is a line that is quite a bit longer than forty characters"
    rows = [(i, "\n".join(line.format(f"{i}-{j}") for j in range(150)) + "\n" + "\n".join(line.format(k) for k in range(i % 20))) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = line_dedup.hashed(d, 40)
    bits = (150_000 * line_dedup.BITS_A_LINE - 1).bit_length()
    assert 0 < line_dedup.suspects(hashes, bits, 5)[0].select("key").distinct().count() - 19 < 0.05 * 150_000
    assert line_dedup.confirmed(hashes).count() == 19


def ids_of(t):
    return encoder(default_path()).library.encode(t or "", add_special_tokens=False).ids


def test_cut_texts_encode_as_whole_ones():
    r = random.Random(3)
    texts = ["", " ", "a  b", "a\n\nb", " a", "a ", "it's, 's", "a\tb \tc", "<|endoftext|> a", "a\r\nb c", "foo ... (x), 12. ab."]
    texts += ["".join(r.choice(["a", "'s", " ", "\n", ".", ",", "1", "é", "\t", "'"]) for _ in range(12)) for _ in range(2000)]
    e = encoder(default_path())
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [ids_of(t) for t in texts]


def test_huffman_files_round_trip(spark, docs, rows, none):
    path = huffman_files.write(docs.withColumn("part", F.lit("mine")))
    length, limit, every = huffman_files.load_code(spark, path)
    assert max(length.values()) <= limit == huffman_files.LIMIT and every == huffman_files.EVERY and sum(2.0**-n for n in length.values()) <= 1
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in huffman_files.read(spark.newSession(), path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(d for d, *_ in rows)
    start = 0
    texts = {d: t for d, t, *_ in rows}
    for d, s, n, crc, ids in got:
        want = [*ids_of(texts[d]), 2]
        assert (s, n, ids, crc) == (start, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        start += n
    assert huffman_files.read(spark, huffman_files.write(none)).count() == 0


def test_files_are_read_by_another_process(docs, rows):
    """Nothing but the path goes to the reader."""
    import subprocess
    import sys

    path = huffman_files.write(docs, limit=17, every=32)
    code = f"""
from pyspark.sql import SparkSession
from mnemoq.llm import huffman_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("tokens", sum(r.n_tokens for r in huffman_files.read(spark, {path!r}).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    assert f"tokens {sum(len(ids_of(t)) + 1 for _, t, *_ in rows)}" in out.stdout, out.stderr[-2000:]


def test_codes_follow_the_vocabulary():
    """More ids than 2**16: codes grow, and blocks decode in words of 32 bits."""
    r = np.random.default_rng(3)
    for limit, n in ((16, 70_000), (17, 90_000), (16, 300_000)):
        ids = np.concatenate([np.arange(n), r.integers(0, 50, 20_000)])
        bits = max(limit, (n - 1).bit_length())
        length = huffman_files.lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True)), bits)
        packed, at = huffman_files.pack(ids, *huffman_files.canonical(length))
        assert max(length.values()) <= bits and (huffman_files.Decoder(length, bits).read(packed, len(ids), at[::64], 64) == ids).all()


def test_blocks_of_empty_texts_take_no_time_for_sums(spark):
    d = spark.range(70_000).selectExpr("id AS doc_id", "cast(null AS string) AS text").coalesce(1)
    out = huffman_files.read(spark, huffman_files.write(d)).agg(F.sum("n_tokens").alias("n"), F.max("start").alias("s")).first()
    assert (out.n, out.s) == (70_000, 69_999)


def test_code_lengths_are_least():
    r = random.Random(1)
    for n in (1, 2, 3, 20):
        counts = {i: r.choice([1, 2, 5, 50, 1000]) for i in range(n)}
        got = huffman_files.lengths(counts, 12)
        heap = sorted(counts.values())
        cost = heap[0] if n == 1 else 0
        while len(heap) > 1:
            a, b = heap[:2]
            cost += a + b
            heap = sorted([*heap[2:], a + b])
        assert sum(counts[s] * k for s, k in got.items()) == cost
    assert max(huffman_files.lengths({i: 2**i for i in range(14)}, 6).values()) <= 6


def test_packing_is_gapless_and_whole(docs, rows, none):
    out = packing.pack(docs, with_ids=True).collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= packing.SIZE
    want = Counter((d, tuple([*ids_of(t), 0])) for d, t, *_ in rows)
    whole = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        whole.setdefault(r.doc_id, []).append(r)
    for (d, ids), k in want.items():
        own = whole[d]
        assert sum(r.length for r in own) == k * len(ids)
        if k == 1:
            assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
    assert packing.pack(none).count() == 0


def test_plan_packs_every_length():
    r = random.Random(2)
    for n in (1, 50, 3000, 30_000):
        h = Counter(min(packing.SIZE, int(r.expovariate(1 / 500)) + 1) for _ in range(n))
        (plan, fitted), got = packing.plan(h), Counter()
        for c, ns in plan:
            assert c > 0 and sum(ns) <= packing.SIZE
            for m in ns:
                got[m] += c
        assert got == h
        least = -(-sum(k * v for k, v in h.items()) // packing.SIZE)
        assert sum(c for c, _ in plan) <= max(least + 1, 1.002 * least)
        assert n < 3000 or fitted > 0.85 * sum(k * v for k, v in h.items())


def test_most_tokens_of_the_tables_lie_by_patterns(spark):
    """Nine tokens in ten (of short texts alone, eight), in at most 0.2 % more sequences than the tokens fill."""
    cut = packing.pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), default_path(), packing.SIZE, packing.END, False)
    h = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    r = random.Random(3)
    for lengths in (h, Counter(r.randrange(5, 120) for _ in range(50_000))):
        plan, fitted = packing.plan(lengths)
        tokens = sum(n * c for n, c in lengths.items())
        assert fitted > (0.9 if lengths is h else 0.8) * tokens and sum(c for c, _ in plan) <= 1.002 * -(-tokens // packing.SIZE)


def test_chat_round_trip_and_mask(spark):
    nasty = [r"\### Assistant: </turn> ok", "a\\", "### User:", "</turn>\n### System: x", "", None, "é\\\\n"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["system", "user", "assistant", "tool", "assistant", "user", "assistant"], nasty))] + [(2, 0, None, "x")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(c.repartition(4))).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[:7])
    loss = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert got[1].n_turns == 7 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 1 and chat.digest(chat.format_turns(c.where("false"))).count() == 0


def test_chat_of_any_roles_and_ids(spark):
    r = random.Random(8)
    bits = ["tool:search", "a:", ":", "\\", "\\:", "Role x", "System", "### User:", "</turn>", "\n", "é", " ", ""]
    rows = [(f"c{r.randrange(6)}", i, "".join(r.choices(bits, k=r.randint(0, 3))), "".join(r.choices(bits, k=3))) for i in range(300)]
    rows += [("c0", 7, "user", "x" * 400_000), ("c0", 7, "user", "x" * 400_000), ("c1", 3, "b", "tie"), ("c1", 3, "a", "tie")]  # long, repeated, tied
    c = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id string, turn long, role string, text string, pieces string").repartition(3)
    got = {x.conv_id: x for x in chat.digest(chat.format_turns(c)).collect()}
    for conv in {x[0] for x in rows}:
        mine = sorted(x[1:] for x in rows if x[0] == conv)
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()


def test_templates_fold_constants_and_refuse_what_is_unsafe():
    f = chat.compile_template('{% if "a" == "a" %}x{{ "y"|upper }}{% else %}{{ text }}{% endif %}')
    assert f({"role": "", "text": "t", "turn": 0}) == [("xY", False)]
    for bad in ("{{ text.__class__ }}", "{{ open }}", "{% for x in y %}", "{% if role == user %}{% endif %}", "{% generation %}", "{{ text|eval }}"):
        with pytest.raises(ValueError):
            chat.compile_template(bad)


def test_urls_by_longest_match(spark):
    urls = [(1, "http://WWW.Example.com/en/x?q"), (2, "http://a.example.com/en/"), (3, "http://a.example.com/en"), (4, "https://x.net/es/1#t"), (5, "https://x.net/esx/"), (6, "no"), (7, None), (8, "http://example.com"), (9, "ftp://notexample.com/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("a.example.com", "/en", "com/", "allow"),
        4: ("x.net", "/es/1", "net/es/", "block"), 5: ("x.net", "/esx/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.com", "", None, "allow"), 9: ("notexample.com", "/en/", "com/", "allow")}


def test_urls_against_all_rules(spark):
    """Random rules and urls: every rule is tried on every url; longest host and path together, then longest host, then the last given."""
    r = random.Random(9)
    hosts, paths = ["", "com", "a.com", "b.a.com", "x.b.a.com", "net"], ["", "/", "/a", "/a/", "/a/b", "/a/b/long/path/here", "/x y"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(paths)) for _ in range(25)] + [("allow", "com", "/a/b/long/path/here"), ("block", "b.a.com", "/")]
    urls = [f"{s}{h}{p}{q}" for s in ("http://", "", "a://b://") for h in ["com", "A.com", "b.a.com", "y.x.b.a.com", "nota.com", "net", ""] for p in ["", "/", "/a", "/ab", "/a/b", "/a/b/long/path/here/x", "/x y"] for q in ("", "?q=/a", "#/a")]
    urls += ["http://com/" + "a/" * 50_000, "", urls[0], urls[0]]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules, "none").collect()
    assert len(got) == len(urls)
    for x in got:
        best = None
        for at, (v, h, p) in enumerate(rules):
            fits = (not h or x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)
            if fits and (best is None or (len(h + p), len(h), at) >= best[0]):
                best = ((len(h + p), len(h), at), h + p, v)
        assert (x.rule, x.verdict) == (best[1:] if best else (None, "none")), x
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_language_model_beats_its_base_on_held_out_rows(spark, none):
    r = random.Random(5)
    follow = {w: r.sample(WORDS, 3) for w in WORDS}
    rows = []
    for i in range(150):
        w = [r.choice(WORDS)]
        for _ in range(200):
            w.append(r.choice(follow[w[-1]]))
        rows.append((i, " ".join(w), "e", 0))
    rows += [(1000, None, "e", 0), (1001, "", "e", 0), (1002, "unseen", "e", 0)]
    out = lm_score.score(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    c = Counter(w for d, t, *_ in rows if not held[d] for w in lm_score.words_of(t))
    n, v = sum(c.values()), len(c)
    for x in out:
        w = lm_score.words_of({d: t for d, t, *_ in rows}[x.doc_id])
        base = sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(w), sum(c[k] > 0 for k in w), n)
        assert abs(x.base_score - base) < 1e-6 * abs(base)
    test = [x for x in out if x.held_out and x.n_tokens > 50]
    assert sum(x.score for x in test) > 0.35 * sum(x.base_score for x in test)
    assert lm_score.score(none).count() == 0


def spelled_row(words, index):
    ids = np.array([index.get(w, 0) for w in words], np.int64)
    return ids, np.array([zlib.crc32(w) for w, i in zip(words, ids) if not i], "<u4"), np.array([lm_score.START, lm_score.START, 0], "<u4")


def small_model(bits=12):
    return lm_score.Model(huffman_files.lengths({0: 3, 1: 9, 2: 5, 3: 1, **{i: 1 + i % 5 for i in range(4, 40)}}, 12), 5, bits), {**{b"": 1, b"a": 2, b"b": 3}, **{b"h%d" % i: i for i in range(4, 40)}}


def plain_bits(model, row):
    """Bit by bit, in plain Python: (symbol's place, bit, gate, slots in the four tables)."""
    m32, out = 0xFFFFFFFF, []

    def mixed(h):
        h = (h ^ h >> 16) * 0x85EBCA6B & m32
        return (h ^ h >> 13) * 0xC2B2AE35 & m32

    one, two, sign, place, rare = *map(int, row[2]), 0, list(map(int, row[1]))
    for i in row[0].tolist():
        name = i or rare[0] | 1 << 31
        for symbol in [i] if i else [0, model.first_bucket + (rare.pop(0) & model.buckets - 1)]:
            a = mixed((one + 1) & m32)
            seeds = [0, a, mixed((a + two) & m32), mixed((sign + 0x51ED27) & m32)]
            for line in range(model.begin[symbol], model.begin[symbol] + model.lines[symbol]):
                slot = 1
                for k in range(model.valid[line]):
                    bit = int(model.four[line]) >> 3 - k & 1
                    slots = []
                    for s in seeds:
                        h = (int(model.node[line]) + s) & m32
                        h = (h ^ h >> 15) * 0x2C1B3C6D & m32
                        slots.append(h >> 36 - model.bits << 4 | slot)
                    out.append((place, bit, min(int(model.gate[line]) + k, int(model.last_gate[line])), slots))
                    slot = 2 * slot | bit
            place += 1
        one, two, sign = name, one, i if 0 < i <= lm_score.COMMON else sign
    return out


def test_scores_and_counts_against_a_plain_loop(spark):
    """The same sums as one bit after the other gives: counts of bits, and the score with weights refined by rounds."""
    r, (model, index) = random.Random(4), small_model()
    vocabulary = [*index][2:] + [b"rare%d" % i for i in range(30)]
    rows = [spelled_row([r.choice(vocabulary) for _ in range(n)] + [b""], index) for n in [0, 1, 5, 7, 8, 9, 30, 200, 1500, *(r.randrange(1, 80) for _ in range(41))]]
    code = (huffman_files.lengths({0: 3, 1: 9, 2: 5, 3: 1, **{i: 1 + i % 5 for i in range(4, 40)}}, 12), 5, 12)
    counts = np.zeros((lm_score.CONTEXTS << 12, 2), np.int64)
    for row in rows:
        for _, bit, _, slots in plain_bits(model, row):
            for i, k in enumerate(slots):
                counts[(i << 12) + k, bit] += 1
    spelled = spark.createDataFrame([(a.astype("<u2").tobytes(), b.tobytes(), c.tobytes(), True) for a, b, c in rows], "ids binary, rare binary, before binary, train boolean").repartition(3)
    got = lm_score.count_bits(spelled, spark.sparkContext.broadcast(code), False)
    assert (got == counts).all()
    tables = lm_score.predictions(got[:, 0].astype(np.float32), got[:, 1].astype(np.float32))
    weights = np.random.default_rng(2).normal(0.3, 0.2, (lm_score.CONTEXTS, lm_score.GATES)).astype(np.float32)
    want = []
    for row in rows:
        own, total, now, grads, seen = np.zeros((lm_score.CONTEXTS, lm_score.OWN)), 0.0, 0, np.zeros((lm_score.CONTEXTS, lm_score.OWN)), np.zeros(lm_score.OWN)
        for place, bit, gate, slots in plain_bits(model, row):
            turn = 7 + place // 1024 if place >= 1024 else max(place.bit_length() - 3, 0)
            if turn != now:
                own += lm_score.RATE_OWN * grads / np.sqrt(seen + 1)
                grads[:], seen[:], now = 0, 0, turn
            v = [int(tables[i][k]) for i, k in enumerate(slots)]
            x, sure = np.array([(k >> 1) / lm_score.SCALE for k in v]), sum(k & 1 for k in v)
            o = lm_score.CONFIDENCE * (gate >= lm_score.DEPTHS) + sure
            p = 1 / (1 + math.exp(-float(np.clip((weights[:, lm_score.CONFIDENCE * gate + sure] + own[:, o]) @ x, -20, 20))))
            total += math.log(p if bit else 1 - p)
            grads[:, o] += (bit - p) * x
            seen[o] += 1
        want.append(total)
    got = lm_score.log_likelihoods(model, tables, weights, rows)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_counting_adds_once_a_line(spark):
    """A line's bits are counted by its last node; sums over the nodes before are those of every bit."""
    model, index = small_model()
    ids, rare, before = spelled_row([*index][2:] + [b"rare%d" % i for i in range(9)] + [b""], index)
    symbol, seeds, _ = model.symbols([(ids, rare, before)])
    n, lines, firsts = model.lines_of(symbol, seeds)
    bit, valid, _, slot = model.spread(lines)
    assert int(n.sum()) == len(lines) == len(firsts[0]) and valid.sum() > 2 * len(lines) > 0
    for k in range(len(lines)):
        used = int(valid[:, k].sum())
        nodes = [2 * int(slot[j, k]) + int(bit[j, k]) for j in range(used)]
        assert nodes == [int(model.last[lines[k]]) >> used - 1 - j for j in range(used)]


def test_words_of_many_texts_are_those_of_each():
    """Arrow's split of a whole batch gives the words of bytes.split() and the end, whatever the spaces; each row comes once."""
    odd = [None, "", " ", "\n\n", "a", " a", "a ", "\t A\x0bB\x0c\r\nc  ", "\u00c9t\u00c9 \u00a0x\u2003Y", "\x1c\x1d\x1e\x1f\x85 q", "\x00 \x00", *(f"Z{chr(i)}y" for i in range(0x180)), "\U0001f600 \U00010400"]
    for texts in (odd, [], [None], ["", None, "w"]):
        n, words = lm_score.words_in(pa.array(texts, pa.string()))
        got, at = lm_score.bytes_of(words), 0
        for t, k in zip(texts, n.tolist(), strict=True):
            assert got[at : at + k] == lm_score.words_of(t), repr(t)
            at += k
        assert at == len(got)
    texts = ["x" * 10, None, "y" * (lm_score.TEXT_BYTES + 1), *["z" * (lm_score.TEXT_BYTES // 3)] * 5]
    parts = [b.column("text").to_pylist() for b in lm_score.texts_of(iter([pa.RecordBatch.from_pydict({"text": texts})]))]
    assert [t for p in parts for t in p] == texts and len(parts) > 2
    assert all(len(p) == 1 or sum(map(len, filter(None, p))) <= lm_score.TEXT_BYTES for p in parts)


def test_one_look_finds_a_lines_predictions():
    """The paths hold, line by line, the predictions that the slots of its bits hold, and those left out the prediction without the bit itself."""
    model, index = small_model()
    symbol, seeds, _ = model.symbols([spelled_row([*index][2:] + [b"rare%d" % i for i in range(40)] + [b""], index)])
    _, lines, firsts = model.lines_of(symbol, seeds)
    bit, valid, gate, slot = model.spread(lines)
    counts = np.random.default_rng(3).integers(1, 60, (lm_score.CONTEXTS << 12, 2)).astype(np.float32)
    zero, one = counts.T
    tables = lm_score.predictions(zero, one)
    less = [lm_score.predictions(zero - 1, one), lm_score.predictions(zero, one - 1)]
    for paths, wanted in ((lm_score.ways(tables), lambda i, k, j: tables[i, k]), (lm_score.left_out(counts), lambda i, k, j: np.where(bit[j], less[1][i, k], less[0][i, k]))):
        x, sure = model.inputs(paths, [f.copy() for f in firsts], lines)
        for j in range(4):
            want = [wanted(i, firsts[i] + slot[j], j) for i in range(lm_score.CONTEXTS)]
            for i in range(lm_score.CONTEXTS):
                assert (x[i].reshape(-1, 4)[:, j] == want[i] >> 1).all(), (i, j)
            assert (sure.view(np.uint16).reshape(-1, 4)[:, j] == sum(w & 1 for w in want)).all()
    signs, gates = model.signs.take(lines).view(np.int8).reshape(-1, 4), model.gates.take(lines).view(np.uint16).reshape(-1, 4)
    assert (signs.T == np.where(valid, 1 - 2 * bit.astype(int), 0)).all() and (gates.T == lm_score.CONFIDENCE * gate.astype(int)).all()


def test_every_training_row_has_a_say_in_the_weights(spark):
    """Each training row alone moves the weights from where they start; rows held out don't."""
    model, index = small_model(10)
    code = (huffman_files.lengths({0: 3, 1: 9, 2: 5, 3: 1, **{i: 1 + i % 5 for i in range(4, 40)}}, 12), 5, 10)
    sent = spark.sparkContext.broadcast(code)
    tables = spark.sparkContext.broadcast(lm_score.left_out(np.random.default_rng(1).integers(1, 50, (lm_score.CONTEXTS << 10, 2)).astype(np.uint16)))
    for i in range(6):
        train = zlib.crc32(str(i).encode()) % 7 != 2
        a, b, c = spelled_row([b"a", b"b", b"rare", b"a", b""], index)
        one = spark.createDataFrame([(i, a.astype("<u2").tobytes(), b.tobytes(), c.tobytes())], "doc_id long, ids binary, rare binary, before binary").withColumn("train", lm_score.training(F.col("doc_id")))
        assert (lm_score.learn(one, sent, tables, False) != np.float32(0.3)).any() == train, i


def test_model_grows_with_the_vocabulary(spark, monkeypatch):
    """Codes, slots and buckets follow the distinct training words; as contexts, words without a code differ too."""
    for of in (lambda v: lm_score.sizes(v)[0], lambda v: lm_score.sizes(v)[1], lm_score.bucket_bits):
        a = [of(v) for v in (10**3, 10**7, 10**8, 10**9)]
        assert a[0] < a[1] < a[2] < a[3]
    used, count = [], lm_score.count_bits
    monkeypatch.setattr(lm_score, "HEAD", 4)
    monkeypatch.setattr(lm_score, "BITS", 10)
    monkeypatch.setattr(lm_score, "count_bits", lambda d, sent, wide: used.append((len(sent.value[0]) - 1, sent.value[2])) or count(d, sent, wide))
    rows = [(i, " ".join(f"n{i}x{k}" for k in range(600)) + " " + " ".join(f"n{i}x{k}" for k in range(600)), "e", 0) for i in range(20)]
    assert lm_score.score(spark.createDataFrame(rows, DOCS)).where("score < 0").count() == 20
    v = len({w for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in lm_score.words_of(t)})
    assert used == [lm_score.sizes(v)] and used[0][0] > 4 and used[0][1] > 10
    model, index = small_model()
    after = [model.symbols([spelled_row([w, b"a"], index)])[1][1:, -1] for w in (b"tail", b"other")]
    assert (after[0][:1] != after[1][:1]).all()


def test_probabilities_add_up():
    """The mixed bits of one context spell a distribution over head words and the escape's buckets."""
    model, index = small_model()
    counts = np.random.default_rng(1).integers(0, 50, (lm_score.CONTEXTS << 12, 2)).astype(np.float32)
    tables, weights, total = lm_score.predictions(counts[:, 0], counts[:, 1]), np.full((lm_score.CONTEXTS, lm_score.GATES), 0.3, np.float32), 0
    buckets = {}
    for i in range(2000):
        buckets.setdefault(zlib.crc32(b"t%d" % i) % 32, b"t%d" % i)
    one = lm_score.log_likelihoods(model, tables, weights, [spelled_row([b"a"], index)])[0]
    for w in [*index, *buckets.values()]:
        total += math.exp(lm_score.log_likelihoods(model, tables, weights, [spelled_row([b"a", w], index)])[0] - one)
    assert len(buckets) == 32 and abs(total - 1) < 1e-4


def test_long_texts_and_strange_rows_are_scored(spark, monkeypatch):
    """Texts longer than a piece, rows that repeat, null doc_ids, string doc_ids and columns that clash."""
    long = text(8, 3 * lm_score.PIECE // 2)
    rows = [("x1", long, 3), ("x1", long, 3), (None, "a b", 1), ("x2", None, 0), ("x3", "", 0)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id string, text string, n_tokens int")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(d), len((t or "").split()) + 1) for d, t, _ in rows)
    assert len({r.score for r in out if r.doc_id == "x1"}) == 1 and all(r.score < 0 for r in out)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.collect()}
        assert now <= seen and now
        assert name != "line dedup" or now == seen
        docs, seen = out, now
    packed = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == seen
