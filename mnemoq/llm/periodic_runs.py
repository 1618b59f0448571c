"""Periodic runs: stretches of a text in which the same words come again and again, found by a suffix
automaton with link-cut access, and the text with each run collapsed to its first period.

A run is a stretch of consecutive words with smallest period q and at least max(min_words, 2 * q) words that
no neighbouring word extends keeping period q.

1. Words are appended one by one to a suffix automaton. The path from the state of the whole prefix to the
   root, along suffix links, holds all suffixes of the prefix; an access of that path, as in a link-cut tree,
   recolours it with the end position i. Before that, the path falls into segments of one colour each: the
   colour c is where the suffixes of the segment, of lengths lo + 1 to hi, ended last.
2. A distance q = i - c with lo < q <= hi is a square with a primitive root of q words that ends at i: the last
   q words ended before at i - q, and nowhere later. hi is the longest common suffix of the two prefixes, so
   the periodic stretch begins at i - hi - q + 1 exactly; it is followed from word to word until its last one.
3. Only words that can lie in a run are appended. In a run of min_words words or more, each word lies in a
   window of min_words / 2 words that the run holds twice. So stretches of words covered by windows which occur
   twice in the same stretch hold all runs, with their neighbours; windows are compared by hash for all
   documents of a batch at once, again and again until no stretch shrinks. Chance only adds words.

Each text is worked on in the task that reads it: nothing is shuffled and nothing is cut. A task's memory follows
its longest stretch, by some 600 bytes for each word of it; words outside stretches need a few numbers.

Defined cases: null, empty and blank texts have no words and no runs, their collapsed text is empty; very long
texts are whole; repeated rows and equal doc_ids are rows of their own; runs of equal length are told apart by
start, then period; an empty table gives no rows; extra columns pass through, whatever their names (but for the
prefix ``_pr_``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, table

MIN_WORDS = 12
BATCH_CHARS = 8_000_000  # characters worked on at once, or one text if that is longer
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def runs_of(symbols: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a list of symbols, by start and period.

    States and link-cut nodes are the same numbers, from 1 (the root); 0 is none. Links form a tree whose
    root never changes, so no path is reversed; a preferred path is a splay tree by depth, of one colour.
    """
    size, link, out = [0, 0], [0, 0], [{}, {}]  # longest suffix of a state, its suffix link, its transitions
    left, right, up = [0, 0], [0, 0], [0, 0]  # splay trees; up of a splay root is the path's parent state
    colour = [0, -1]  # of splay roots: where the path's suffixes ended last
    found: list[tuple[int, int, int]] = []
    open_runs: dict[int, tuple[int, int]] = {}  # period: (start, last word)

    def new(length: int) -> int:
        size.append(length)
        link.append(0)
        out.append({})
        left.append(0)
        right.append(0)
        up.append(0)
        colour.append(-1)
        return len(size) - 1

    def splay(x: int) -> None:
        """Make x the root of its splay tree; the root's colour goes with it."""
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            top = not g or (left[g] != p and right[g] != p)
            if not top:
                z = up[g]
                outer = not z or (left[z] != g and right[z] != g)
                if (left[g] == p) == (left[p] == x):  # in one line: p over g first
                    if left[g] == p:
                        b = left[g] = right[p]
                        right[p] = g
                    else:
                        b = right[g] = left[p]
                        left[p] = g
                    if b:
                        up[b] = g
                    up[g] = p
                    if left[p] == x:
                        b = left[p] = right[x]
                        right[x] = p
                    else:
                        b = right[p] = left[x]
                        left[x] = p
                    if b:
                        up[b] = p
                    up[p] = x
                else:  # in a corner: x over p, then over g
                    if left[p] == x:
                        b = left[p] = right[x]
                        right[x] = p
                        if b:
                            up[b] = p
                        b = right[g] = left[x]
                        left[x] = g
                    else:
                        b = right[p] = left[x]
                        left[x] = p
                        if b:
                            up[b] = p
                        b = left[g] = right[x]
                        right[x] = g
                    if b:
                        up[b] = g
                    up[p] = up[g] = x
                up[x] = z
                if outer:
                    colour[x] = colour[g]
                    return
                if left[z] == g:
                    left[z] = x
                else:
                    right[z] = x
                p = z
            else:
                if left[p] == x:
                    b = left[p] = right[x]
                    right[x] = p
                else:
                    b = right[p] = left[x]
                    left[x] = p
                if b:
                    up[b] = p
                up[p], up[x] = x, g
                colour[x] = colour[p]
                return

    last = 1
    for i, s in enumerate(symbols):
        # the automaton grows by one symbol
        cur = new(i + 1)
        p = last
        while p and s not in out[p]:
            out[p][s] = cur
            p = link[p]
        if not p:
            parent = 1
        else:
            q = out[p][s]
            if size[p] + 1 == size[q]:
                parent = q
            else:  # q's shorter suffixes get a state of their own, above q on its path and of its colour
                parent = new(size[p] + 1)
                out[parent] = dict(out[q])
                link[parent], link[q] = link[q], parent
                while p and out[p].get(s) == q:
                    out[p][s] = parent
                    p = link[p]
                splay(q)
                b = left[parent] = left[q]
                if b:
                    up[b] = parent
                left[q], up[parent] = parent, q
        link[cur] = up[cur] = parent
        last = cur
        # access: from the new state to the root, path by path; each leaves its deeper part behind
        x, below, q, hi = parent, cur, 0, 0
        while x:
            splay(x)
            c = colour[x]
            if q and size[x] < q <= hi:  # the deeper segment's square: its shortest suffix is longer than this one's longest
                start = i - hi - q + 1
                was = open_runs.get(q)
                if was is None or was[0] != start:
                    if was is not None and was[1] - was[0] + 1 >= min_words:
                        found.append((was[0], was[1] - was[0] + 1, q))
                open_runs[q] = (start, i)
            q, hi = i - c, size[x]
            b = right[x]
            if b:
                colour[b] = c
            right[x] = below
            below, x = x, up[x]
        if 0 < q <= hi:
            start = i - hi - q + 1
            was = open_runs.get(q)
            if was is None or was[0] != start:
                if was is not None and was[1] - was[0] + 1 >= min_words:
                    found.append((was[0], was[1] - was[0] + 1, q))
            open_runs[q] = (start, i)
        colour[below] = i
    found += [(a, b - a + 1, q) for q, (a, b) in open_runs.items() if b - a + 1 >= min_words]
    return sorted(found, key=lambda r: (r[0], r[2]))


def _mixed(v: np.ndarray) -> np.ndarray:
    """64 well mixed bits for each number."""
    with np.errstate(over="ignore"):
        v = (v.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys may occur more than once: all that do, and a few that share 32 bits with another."""
    bits = max(8, (4 * len(keys)).bit_length())
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    may = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    out = np.zeros(len(keys), bool)
    if len(may):
        order = may[np.argsort(keys[may])]
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def stretches(codes: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the stretches that can hold runs, for words of many documents in a row."""
    n, w = len(codes), max(1, min_words // 2)
    if n < 2 * w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = _mixed(codes)
    with np.errstate(over="ignore"):
        hashes = one[: n - w + 1].copy()
        for k in range(1, w):
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + one[k : n - w + 1 + k]
        at = np.flatnonzero(doc[: n - w + 1] == doc[w - 1 :])
        hashes, of = hashes[at], doc[at]
        while True:
            keep = _twice(_mixed(hashes + _mixed(of)))
            done = keep.all()
            at, hashes = at[keep], hashes[keep]
            if not len(at):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            # a stretch goes on while the next window begins within the last one or right behind it, in the same document
            fresh = np.ones(len(at), bool)
            fresh[1:] = (at[1:] > at[:-1] + w) | (doc[at[1:]] != doc[at[:-1]])
            of = np.cumsum(fresh) - 1
            if done:
                break
    first = np.flatnonzero(fresh)
    begin, end = at[first], at[np.append(first[1:] - 1, len(at) - 1)] + w
    wide = end - begin >= min_words
    return begin[wide], end[wide]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, split at ASCII white space, and for each the number of its text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), of.filter(some).to_numpy()


def find(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs and _pr_words (count of words), _pr_runs (start, length, period by start, then period) and _pr_text (the
    kept words joined by one space: of each run the first period stays)."""
    names = docs.columns
    text_at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_pr_words", T.LongType()), T.StructField("_pr_runs", T.ArrayType(RUN)), T.StructField("_pr_text", T.StringType())])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        words, of = words_of(b.column(text_at))
        counts = np.bincount(of, minlength=b.num_rows).astype(np.int64)
        base = np.cumsum(counts) - counts
        codes = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int32)
        runs: list[list] = [[] for _ in range(b.num_rows)]
        dropped = np.zeros(len(words) + 1, np.int64)  # how many runs' repeats begin (+) or end (-) at a word
        for begin, end in zip(*(x.tolist() for x in stretches(codes, of, min_words)), strict=True):
            d = int(of[begin])
            for start, length, period in runs_of(codes[begin:end].tolist(), min_words):
                runs[d].append({"start": begin - int(base[d]) + start, "length": length, "period": period})
                dropped[begin + start + period] += 1
                dropped[begin + start + length] -= 1
        kept = np.cumsum(dropped)[:-1] == 0
        left = words if kept.all() else words.filter(pa.array(kept))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=b.num_rows))])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), left), pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(counts), pa.array(runs, run_type), joined], names=[*names, "_pr_words", "_pr_runs", "_pr_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, "right")))
                yield work(b.slice(at, stop - at))
                at = stop

    return docs.mapInArrow(run, schema)


def collapse(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, the same columns and rows; texts with runs become their kept words, others stay as they are."""
    out = find(docs, min_words)
    text = F.when(F.size("_pr_runs") > 0, F.col("_pr_text")).otherwise(F.col("text"))
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the repeats that the query asks for: in documents whose crc32 ends in 0, the words from number a on
    repeat those from a to a + p - 1. Rows without a doc_id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(w, (F.when(i >= a, a + (i - a) % p).otherwise(i) + 1).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), repeat)  # the words are bound once
    return F.when(h % 10 == 0, F.coalesce(F.get(some, F.lit(0)), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("_pr_runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.array_join(F.transform("_pr_runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    return (out.select("doc_id", F.size("_pr_runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("_pr_text").cast("binary"), 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
                    F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))
