"""LM scoring: online logistic context mixing. A text is a sequence of bits; several bit predictors, each
a table of counts addressed by a hash of its context, are combined by weights which a gate selects,
refined adaptively within every document from its first words on; the total is bits per byte.

Spelling. Each training word of the head (the commonest) is a symbol with a Huffman code; any other
word is the escape, then the bits of its hash, so every word meets the mixer. What tells a word from
others of one hash, which no context knows, is its share of their counts, or, for an unknown word, the
chance that words seen once suggest (Good-Turing). The events are those of the base: known words, unknown
ones, and the end; the probabilities of all add up to one at most. Words seen once are outside the head.

Jobs, each over all training rows or all rows: word counts; spelling, stored once with the rows'
numbers; bit counts by hashed context (every task fills tables of one size, whose pieces are summed by
position in a stream); mixing weights, learnt online with each bit left out of the counts it is
predicted from, then averaged over tasks; the score. What is sent to the tasks is ``head`` words with
codes, 2**bits slots for each context, and the weights. Head and slots follow the number of distinct
training words (``sizes``) and have no upper bound, so a task's memory grows with the vocabulary: 4 bytes
a slot for scoring, 5 for learning (``ways``, ``left_out``). The word counts stay in a shuffled table.
Slots have no check value.

Within a document, weights that its own bits call for are added to those learnt, after 8 symbols, 16,
32, ..., and from 1024 on after each 1024.

Defined cases: null text is empty, only its end is scored; without training rows all counts are zero;
repeated rows are scored each; a null doc_id is trained on, not held out; texts of more than ``PIECE``
words are spelled in pieces which know the words before them, and the weights are refined by piece;
an empty table gives no rows; only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, keep_heap, stored, table
from .huffman_files import canonical, lengths

HEAD = (1 << 16) - 1  # this many and BITS at least; more as the vocabulary grows
BITS = 19
WORDS_PER_HEAD, WORDS_PER_SLOT = 32, 4
WORDS_PER_BUCKET = 64  # outside the head; a word's bucket are the last bits of its hash
CONTEXTS = 4  # nothing, the word before, the two before, the last of the commonest words before (a sign of language and kind)
SEEN = (1 << 30, 30, 8, 20)  # from how many on a context counts as often seen; the first never tells
COMMON = 96
DEPTHS, BUCKET_DEPTHS, CONFIDENCE = 16, 8, 4
GATES = (DEPTHS + BUCKET_DEPTHS) * CONFIDENCE
OWN = 2 * CONFIDENCE  # gates of the weights that a document adds
STEP = 2048  # symbols between two updates while the weights are learnt
RATE, RATE_OWN = 0.05, 0.15
MAP_PIECE = 1 << 12
PIECE = 1 << 16
CHUNK = 2048  # symbols at a time, so that what is made of them stays near
TEXT_BYTES = 1 << 22  # of texts split at a time, or one text
SCALE = 1500.0  # of stretched predictions, which are kept as integers
END = b""
START = np.uint32(0x7FFFFFFF)
FOURS = np.uint64(0x0001000100010001)  # one in each of four numbers of 16 bits side by side
AT_ONCE = 256  # rows scored together; their gates are numbered in 16 bits


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        return (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)


def sizes(v: int) -> tuple[int, int]:
    """(head, bits) for so many distinct training words: in proportion to them. Slots are numbered in 32 bits with one to
    spare, so from 2**33 words on they don't get more; each then stands for more words."""
    return max(HEAD, v // WORDS_PER_HEAD), min(31, max(BITS, (max(v // WORDS_PER_SLOT, 1) - 1).bit_length()))


def bucket_bits(v: int) -> int:
    """Of the hash of a word outside the head, how many bits the model spells; they follow the vocabulary, too."""
    return max(4, (v // WORDS_PER_BUCKET).bit_length())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes.lower() and bytes.split() know ASCII alone, as asked for."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same for many texts: how many words each has, and all words. Arrow's ascii functions take the same bytes for letters and spaces."""
    t = pc.ascii_ltrim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    t = pc.if_else(pc.equal(t, ""), t, pc.binary_join_element_wise(t, "", " "))  # what follows the last space is the end
    lists = pc.ascii_split_whitespace(t)
    return lists.value_lengths().to_numpy(), lists.flatten()


def bytes_of(words: pa.Array) -> list[bytes]:
    """As to_pylist() gives them, but without a scalar for each."""
    return words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of TEXT_BYTES or fewer, or of one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + TEXT_BYTES, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def training(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over training rows; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_of(batches):
            found = pc.value_counts(words_in(b.column("text"))[1])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["word", "n"])

    return docs.where("train").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- spelling ------------------------------------------------------------------------------------
def names_of(ids: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """What stands for the words as contexts: their ids, or a hash above all ids."""
    names = ids.astype(np.uint32)
    names[ids == 0] = rare | np.uint32(1 << 31)
    return names


def spell(docs: DataFrame, sent, wide: bool) -> DataFrame:
    """(_lm_id, doc_id, train, n_bytes, ids, rare, tail, before): ids of words (0: not in the head), the hashes of
    those with 0 and their bytes, each with a line break, and the contexts before the piece. One row per PIECE words."""
    code = np.dtype("<u4" if wide else "<u2")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i + 1 for i, w in enumerate(sent.value)}.get
        for b in texts_of(batches):
            at, sizes_, ids, rares, tails, befores = [], [], [], [], [], []
            n_bytes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            n_words, words = words_in(b.column("text"))
            # each distinct word is looked up once
            words = words.dictionary_encode()
            word, distinct = words.indices.to_numpy(), bytes_of(words.dictionary)
            id_of = np.fromiter(map(get, distinct, repeat(0)), code, len(distinct))
            hash_of = np.fromiter((0 if i else crc32(w) for w, i in zip(distinct, id_of.tolist(), strict=True)), "<u4", len(distinct))
            ends = np.cumsum(n_words, dtype=np.int64).tolist()
            for i, (first, end) in enumerate(zip([0, *ends], ends, strict=False)):
                before = (START, START, np.uint32(0))
                for lo in range(first, end, PIECE):
                    part = word[lo : min(lo + PIECE, end)]
                    x = id_of[part]
                    tail = part[x == 0]
                    rare = hash_of[tail]
                    at.append(i)
                    sizes_.append(n_bytes[i] if lo == first else 0)
                    ids.append(x.tobytes())
                    rares.append(rare.tobytes())
                    tails.append(b"\n".join([*map(distinct.__getitem__, tail.tolist()), b""]))
                    befores.append(np.array(before, "<u4").tobytes())
                    if end > lo + PIECE:
                        own = names_of(x, rare)
                        common = np.flatnonzero((x > 0) & (x <= COMMON))
                        before = (own[-1], own[-2] if len(own) > 1 else before[0], np.uint32(x[common[-1]]) if len(common) else before[2])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("_lm_id", "doc_id", "train")), pa.array(sizes_, pa.int64()), *(pa.array(c, pa.binary()) for c in (ids, rares, tails, befores))],
                names=["_lm_id", "doc_id", "train", "n_bytes", "ids", "rare", "tail", "before"])

    d = docs.withColumn("_lm_id", F.monotonically_increasing_id())
    return d.select("_lm_id", "doc_id", "train", "text").mapInArrow(run, f"_lm_id long, doc_id {id_type}, train boolean, n_bytes long, ids binary, rare binary, tail binary, before binary")


# A context's predictions as its lines' bits meet them on their way, several in one number, so that one look finds
# them: (shift, numbers) for each part of the way, by first slot + four bits, shifted.
Paths = list[tuple[int, np.ndarray]]


class Model:
    """Codes of words and of buckets, and the way from spelled rows to bits and slots.

    Codes are cut into lines of four bits. The nodes that a line's bits leave have 16 slots side by side, found by
    one hash of the context and the line's first node. Arrays of bits have the four places of each line side by side,
    as numbers of 16 bits in one of 64; the places past a code's end are there, too, and marked.
    """

    def __init__(self, word_lengths: dict[int, int], bucket_bits: int, bits: int):
        self.bits, self.buckets = bits, 1 << bucket_bits
        parts = []
        even = np.arange(self.buckets, dtype=np.uint32), np.full(self.buckets, bucket_bits, np.uint8)
        for (codes, lens), deepest, gate, salt in ((canonical(word_lengths), DEPTHS, 0, 0), (even, BUCKET_DEPTHS, DEPTHS, 0x5BD1E995)):
            n = lens.astype(np.int64)
            lines = (n + 3) // 4
            word = np.repeat(np.arange(len(lens)), lines)
            k = np.arange(len(word)) - np.repeat(np.cumsum(lines) - lines, lines)
            after = (n[word] - 4 * k).astype(np.int64)  # bits from the line's first on
            code = codes[word].astype(np.uint64)
            node = (np.uint64(1) << (4 * k).astype(np.uint64)) | code >> after.astype(np.uint64)
            four = (code << np.uint64(4)) >> after.astype(np.uint64) & np.uint64(15)
            with np.errstate(over="ignore"):
                hashed = node.astype(np.uint32) * np.uint32(0x9E3779B1) ^ np.uint32(salt)
            parts.append((lines, hashed, four.astype(np.uint8), np.minimum(after, 4).astype(np.uint8), np.minimum(gate + 4 * k, gate + deepest).astype(np.uint8)))
        self.first_bucket = len(parts[0][0])
        self.lines, self.node, self.four, self.valid, self.gate = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.begin = np.cumsum(self.lines) - self.lines
        self.last = (np.uint8(1) << self.valid | self.four >> (np.uint8(4) - self.valid)).astype(np.int64)  # the node behind a line's last bit
        self.first_bucket_line = len(parts[0][1])
        self.last_gate = np.where(np.arange(len(self.gate)) < self.first_bucket_line, DEPTHS, DEPTHS + BUCKET_DEPTHS).astype(np.uint8) - np.uint8(1)
        bit, valid, gate, _ = self.spread(np.arange(len(self.four)))
        self.signs = np.ascontiguousarray((valid.view(np.int8) - 2 * (bit & valid).view(np.int8)).T).view(np.uint32).reshape(-1)  # of each place 1, of a one -1, where no bit is 0
        self.gates = np.ascontiguousarray(CONFIDENCE * gate.T.astype(np.uint16)).view(np.uint64).reshape(-1)

    def symbols(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of spelled rows: the symbols; three seeds of contexts for each; and where the rows begin."""
        ids, rare = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        before = np.stack([r[2] for r in rows])
        size = np.array([len(r[0]) for r in rows])
        first = np.cumsum(size) - size
        names = names_of(ids, rare)
        one, two = np.empty_like(names), np.empty_like(names)
        one[1:], two[2:] = names[:-1], names[:-2]
        two[first[size > 1] + 1] = before[size > 1, 0]
        one[first], two[first] = before[:, 0], before[:, 1]
        last = np.full(len(ids), -1)
        last[1:] = np.maximum.accumulate(np.where((ids > 0) & (ids <= COMMON), np.arange(len(ids)), -1))[:-1]
        sign = np.where(last >= np.repeat(first, size), ids[np.maximum(last, 0)].astype(np.uint32), np.repeat(before[:, 2], size))
        with np.errstate(over="ignore"):
            a = _mixed(one + np.uint32(1))
            seeds = np.stack([a, _mixed(a + two), _mixed(sign + np.uint32(0x51ED27))])
        # an escape is followed by its bucket, in the same contexts
        times = 1 + (ids == 0)
        at = np.cumsum(times) - times
        symbol = np.repeat(ids, times)
        symbol[at[ids == 0] + 1] = (rare & np.uint32(self.buckets - 1)).astype(np.int64) + self.first_bucket
        return symbol, np.repeat(seeds, times, axis=1), at[first]

    def lines_of(self, symbol: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of symbols: how many lines each has, the lines, and in each context's table the first of the 16 slots of each line."""
        n = self.lines.take(symbol)
        ends, of = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        at = np.arange(len(of))
        at += (self.begin.take(symbol) - (ends - n)).take(of)
        node, firsts = self.node.take(at), []
        for i in range(CONTEXTS):
            k = node.copy() if i == 0 else seeds[i - 1].take(of)
            if i:
                k += node
            k ^= k >> np.uint32(15)
            k *= np.uint32(0x2C1B3C6D)
            k >>= np.uint32(36 - self.bits)
            k <<= np.uint32(4)
            firsts.append(k.astype(np.int64))
        return n, at, firsts

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each place in lines: its bit, whether it is one, its gate, and its slot among the line's."""
        four, place = self.four.take(at), np.arange(4, dtype=np.uint8)[:, None]
        bit = four >> (np.uint8(3) - place) & np.uint8(1)
        valid = (place < self.valid.take(at)).view(np.uint8)
        gate = np.minimum(self.gate.take(at) + place, self.last_gate.take(at))
        return bit, valid, gate, np.uint8(1) << place | four >> (np.uint8(4) - place)

    def inputs(self, tables: list[Paths], firsts: list[np.ndarray], lines: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The predictions of the contexts' tables on the lines' ways, stretched, times SCALE; and how many contexts are often seen at each place."""
        x, sure, four = [], None, self.four.take(lines).astype(np.int64)
        for own, k in zip(tables, firsts, strict=True):
            k += four
            v = [part.take(k >> np.int64(shift) if shift else k, mode="clip") for shift, part in own]
            v = v[0] if len(v) == 1 else np.stack(v, axis=1).view(np.uint64).reshape(-1)
            sure = v & FOURS if sure is None else sure + (v & FOURS)
            v = v.view(np.int16)
            v >>= np.int16(1)
            x.append(v.astype(np.float32))
        return x, sure


def spelled_rows(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[list, pa.RecordBatch]]:
    """Spelled rows in groups of bounded size, each with its part of the batch."""
    code = np.dtype("<u4" if wide else "<u2")

    def made(b: pa.RecordBatch) -> tuple[list, pa.RecordBatch]:
        cols = (b.column(c).to_pylist() for c in ("ids", "rare", "before"))
        return [(np.frombuffer(i, code).astype(np.int64), np.frombuffer(r, "<u4"), np.frombuffer(x, "<u4")) for i, r, x in zip(*cols, strict=True)], b

    for b in batches_of(batches):
        size = np.cumsum([len(x) for x in b.column("ids").to_pylist()]) // code.itemsize
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 4 * PIECE, side="right")))
            yield made(b.slice(lo, hi - lo))
            lo = hi


# ---- what is gathered from the corpus ------------------------------------------------------------
def count_bits(spelled: DataFrame, sent, wide: bool) -> np.ndarray:
    """(CONTEXTS << bits, 2) counts of zeros and ones, context by context, scaled down where they don't fit 16 bits.

    Bit b of slot j leads to node 2 * j + b of a line. Tasks count each line once, at the node behind its last bit;
    a node's count is then its own and those of the two nodes after it.
    """
    bits = sent.value[2]
    size = CONTEXTS << bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        model, counts = Model(*sent.value), np.zeros(2 * size, np.uint32)
        for rows, _ in spelled_rows(batches, wide):
            symbol, seeds, _ = model.symbols(rows)
            for lo in range(0, len(symbol), CHUNK):
                _, lines, firsts = model.lines_of(symbol[lo : lo + CHUNK], seeds[:, lo : lo + CHUNK])
                last, once = model.last.take(lines), np.ones(len(lines), np.uint32)
                for i, k in enumerate(firsts):
                    k += i << bits
                    k += k
                    k += last
                    np.add.at(counts, k, once)
        for k in range(0, size, MAP_PIECE):
            part = counts[2 * k : 2 * (k + MAP_PIECE)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // MAP_PIECE], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["piece", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(x, decompressed_size=8 * min(MAP_PIECE, size), codec="zstd", asbytes=True), np.uint32).reshape(-1, 2)
                total[k] = total[k] + got if k in total else got.astype(np.uint64)
        for k, t in total.items():
            nodes = t.reshape(-1, 32)
            for j in range(15, 1, -1):
                nodes[:, j] += nodes[:, 2 * j] + nodes[:, 2 * j + 1]
            over = np.maximum(np.uint64(1), (t.max(axis=1) + np.uint64(59_999)) // np.uint64(60_000))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(t // over[:, None]).astype(np.uint16).tobytes()], pa.binary())], names=["piece", "counts"])

    parts = spelled.where("train").select("ids", "rare", "before").mapInArrow(build, "piece int, counts binary").repartition("piece")
    out = np.zeros((size, 2), np.uint16)
    for r in parts.mapInArrow(merge, "piece int, counts binary").toLocalIterator():  # tables of one size
        got = np.frombuffer(r.counts, np.uint16).reshape(-1, 2)
        out[r.piece * MAP_PIECE : r.piece * MAP_PIECE + len(got)] = got
    return out


def predictions(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Per slot an integer: the stretched prediction, and in its lowest bit whether the context is often seen."""
    st = np.clip(np.log(one + np.float32(0.05)) - np.log(zero + np.float32(0.05)), -10, 10)
    often = (zero + one).reshape(CONTEXTS, -1) > np.array(SEEN, np.float32)[:, None]
    return ((np.rint(st * SCALE).astype(np.int16) << 1) + often.reshape(-1)).reshape(CONTEXTS, -1)


def ways(tables: np.ndarray) -> list[Paths]:
    """Predictions by slot as paths. A bit's slot follows from the bits before it, so the last of four doesn't tell."""
    four = np.arange(8)
    return [[(1, side_by_side(own.reshape(-1, 16), [8 + four >> 3 - k for k in range(4)]))] for own in tables]


def side_by_side(lines: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """Of each line the entries at places, those of one index in one number."""
    out = np.empty((len(lines), len(places[0]), len(places)), np.int16)
    for k, place in enumerate(places):
        out[:, :, k] = lines[:, place]
    return out.view(np.uint64 if len(places) == 4 else np.uint32).reshape(-1)


def left_out(counts: np.ndarray) -> list[Paths]:
    """The same for bits left out of the counts they are predicted from, as paths, in two parts of two bits."""
    zero, one = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    four, out = np.arange(16), []
    for own in np.stack([predictions(np.maximum(zero - 1, 0), one), predictions(zero, np.maximum(one - 1, 0))], axis=2):
        own = own.reshape(-1, 32)
        out.append([(2, side_by_side(own, [2 + (four[:4] >> 1), 4 + four[:4]])), (0, side_by_side(own, [8 + (four >> 1), 16 + four]))])
    return out


def learn(spelled: DataFrame, sent, tables, wide: bool) -> np.ndarray:
    """(CONTEXTS, GATES) weights, learnt online in every task over all its training rows, averaged by the bits seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        model, table_ = Model(*sent.value), tables.value
        w, seen = np.full((CONTEXTS, GATES), 0.3, np.float32), np.zeros(GATES)
        moved = np.full(w.shape, 1e-3)  # squares of the steps so far: the more a weight has moved, the less it does
        for rows, _ in spelled_rows(batches, wide):
            symbol, seeds, _ = model.symbols(rows)
            for lo in range(0, len(symbol), STEP):
                _, lines, firsts = model.lines_of(symbol[lo : lo + STEP], seeds[:, lo : lo + STEP])
                x, sure = model.inputs(table_, firsts, lines)
                g = (sure + model.gates.take(lines)).view(np.uint16).astype(np.int64)
                sign = model.signs.take(lines).view(np.int8).astype(np.float32)
                bits = np.abs(sign)
                err = _surprise(sign, bits, _mix(w * np.float32(1 / SCALE), g, x))[1]
                step = np.stack([np.bincount(g, np.multiply(err, v, out=v), GATES) for v in x]) / SCALE
                moved += step**2
                w += (RATE * step / np.sqrt(moved)).astype(np.float32)
                seen += np.bincount(g, bits, GATES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES)), pa.array(seen.astype(np.int64)), *(pa.array(wi.astype(np.float64) * seen) for wi in w)], names=["gate", "n", *cols])

    cols = [f"w{i}" for i in range(CONTEXTS)]
    rows = spelled.where("train").select("ids", "rare", "before").mapInArrow(run, "gate long, n long, " + ", ".join(f"{c} double" for c in cols)).groupBy("gate").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in cols)).collect()
    out = np.full((CONTEXTS, GATES), 0.3, np.float32)
    for r in rows:  # a row for each gate
        if r.n:
            out[:, r.gate] = [r[c] / r.n for c in cols]
    return out


def _mix(weights: np.ndarray, g: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    """The sum of the contexts' predictions x by their weights at g."""
    out = None
    for wi, v in zip(weights, x, strict=True):
        part = wi.take(g, mode="clip")
        part *= v
        out = part if out is None else np.add(out, part, out=out)
    return out


def _surprise(sign: np.ndarray, bits: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one over the probability given to the bits, what their predictions lack), from stretched predictions t; 1 and 0 where no bit is.
    Four of the first multiplied stay below 1e35."""
    t *= sign
    np.clip(t, -20, 20, out=t)
    e = np.exp(t, out=t)
    e *= bits
    e1 = e + np.float32(1)
    e /= e1
    e *= sign
    return e1, np.negative(e, out=e)


def rounds(place: np.ndarray) -> np.ndarray:
    """The round of refinement in which a document's symbol is: 8 symbols, 8, 16, 32, ..., then 1024 each."""
    return np.where(place < 1024, np.maximum(np.frexp(place)[1] - 3, 0), 7 + place // 1024)


def log_likelihoods(model: Model, tables: np.ndarray, weights: np.ndarray, rows: list) -> np.ndarray:
    """Natural logs of the rows' probabilities, by the predictions in slots."""
    ways_ = ways(tables)
    return np.concatenate([np.zeros(0), *(logs_of(model, ways_, weights, rows[k : k + AT_ONCE]) for k in range(0, len(rows), AT_ONCE))])


def logs_of(model: Model, tables: list[Paths], weights: np.ndarray, rows: list) -> np.ndarray:
    """The same for AT_ONCE rows or fewer, by paths. All rows of a round are looked at together, then each one's own weights move."""
    symbol, seeds, first = model.symbols(rows)
    size = np.diff([*first, len(symbol)])
    row = np.repeat(np.arange(len(rows)), size)
    turn = rounds(np.arange(len(symbol)) - np.repeat(first, size))
    # a row's last round moves no weights that are used again; its symbols come last in the round
    ends = turn == np.repeat(turn[np.cumsum(size) - 1], size)
    order = np.argsort(2 * turn + ends, kind="stable")
    moving = np.cumsum(~ends[order])
    symbol, seeds, row, turn = symbol[order], seeds[:, order], row[order], turn[order]
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
    own = np.zeros((CONTEXTS, len(rows) * OWN), np.float32)
    by_row, own_by_row = np.zeros(len(rows), np.uint64), FOURS * np.arange(0, len(rows) * OWN, CONFIDENCE, np.uint64)
    out = np.zeros(len(rows))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        # the weights of each row in this round: those learnt and its own, which know words of the head from buckets alone
        live = np.flatnonzero(np.bincount(row[lo:hi], minlength=len(rows)))
        by_row[live] = FOURS * np.arange(0, len(live) * GATES, GATES, np.uint64)
        both = np.repeat(own.reshape(CONTEXTS, len(rows), 2, CONFIDENCE)[:, live], [DEPTHS, BUCKET_DEPTHS], axis=2).reshape(CONTEXTS, len(live), GATES)
        both = ((both + weights[:, None]) * np.float32(1 / SCALE)).reshape(CONTEXTS, -1)
        grads, seen = np.zeros(own.shape), np.zeros(own.shape[1])
        mid = lo + int(moving[hi - 1] - (moving[lo - 1] if lo else 0))
        for a, b in [(a, min(a + CHUNK, to)) for since, to in ((lo, mid), (mid, hi)) for a in range(since, to, CHUNK)]:
            at = slice(a, b)
            n, lines, firsts = model.lines_of(symbol[at], seeds[:, at])
            x, sure = model.inputs(tables, firsts, lines)
            of = np.repeat(row[at], n)
            g = (sure + model.gates.take(lines) + by_row.take(of)).view(np.uint16).astype(np.int64)
            sign = model.signs.take(lines).view(np.int8).astype(np.float32)
            bits = np.abs(sign)
            e1, err = _surprise(sign, bits, _mix(both, g, x))
            e1 = e1.reshape(-1, 4)
            out -= np.bincount(of, np.log(e1[:, 0] * e1[:, 1] * e1[:, 2] * e1[:, 3]), len(rows))
            if b <= mid:
                of *= 2
                of += lines >= model.first_bucket_line
                r = (sure + own_by_row.take(of)).view(np.uint16).astype(np.int64)
                for i, v in enumerate(x):
                    grads[i] += np.bincount(r, np.multiply(err, v, out=v), own.shape[1])
                seen += np.bincount(r, bits, own.shape[1])
        if mid > lo:
            own += (RATE_OWN / SCALE * grads / np.sqrt(seen + 1)).astype(np.float32)
    return out


# ---- jobs ----------------------------------------------------------------------------------------
def fit(docs: DataFrame, head: int | None = None, bits: int | None = None):
    """All that is gathered from training rows of docs (doc_id, text, train): the word counts' totals, the stored
    rows, whether their ids are wide, the codes as sent, the head's counts, predictions, weights, and shares (word, n, share)."""
    spark = docs.sparkSession
    words = stored(count_words(docs), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)).alias("once")).first()
    head, bits = (given if given is not None else own for given, own in zip((head, bits), sizes(total.v), strict=True))
    top = words.where("n > 1").orderBy(F.desc("n"), "word").limit(head).toArrow()  # follows the vocabulary
    names, ns = top.column("word").to_pylist(), top.column("n").to_pylist()
    wide, tail_n = len(names) >= 1 << 16, total.n - sum(ns)
    spelled = stored(spell(docs, spark.sparkContext.broadcast(names), wide), "lm-spelled")
    code = lengths({0: tail_n + 1, **{i + 1: n for i, n in enumerate(ns)}}, max(24, len(ns).bit_length() + 3))
    sent = spark.sparkContext.broadcast((code, bucket_bits(total.v), bits))
    counts = count_bits(spelled, sent, wide)
    for_learning = spark.sparkContext.broadcast(left_out(counts))
    weights = learn(spelled, sent, for_learning, wide)
    for_learning.unpersist()
    scores = ways(predictions(counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)))
    # within its bucket a word outside the head has its count's share; an unknown one what is left for new words
    novel = (total.once + 1) / (total.once + 1 + tail_n)
    outside = (F.col("n") < ns[-1]) | ((F.col("n") == ns[-1]) & (F.col("word") > F.lit(names[-1]))) if ns else F.lit(True)
    bucket = F.crc32("word").bitwiseAND((1 << bucket_bits(total.v)) - 1)
    tail = words.where(outside).withColumn("bucket", bucket)
    all_of = tail.groupBy("bucket").agg(F.sum("n").alias("all"))  # 2**bucket_bits rows
    shares = tail.join(F.broadcast(all_of), "bucket").select("word", "n", ((1 - novel) * F.col("n") / F.col("all")).alias("share"))
    return total, spelled, wide, sent, ns, scores, weights, shares, novel


def score(docs: DataFrame, head: int | None = None, bits: int | None = None) -> DataFrame:
    """docs (doc_id, text) scored: the base's columns, score (log10), bits_per_byte. Sizes follow the vocabulary unless given."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text").withColumn("train", training(F.col("doc_id")))
    total, spelled, wide, sent, ns, scores, weights, shares, novel = fit(d, head, bits)
    mixing = spark.sparkContext.broadcast((scores, weights))
    known = spark.sparkContext.broadcast(np.log10(np.array([1, *(n + 1 for n in ns)]) / (total.n + total.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        model, base = Model(*sent.value), known.value
        for rows, b in spelled_rows(batches, wide):
            n = [len(r[0]) for r in rows]
            in_head = [int((r[0] > 0).sum()) for r in rows]
            base_head = [float(base[r[0][r[0] > 0]].sum()) for r in rows]
            logs = logs_of(model, *mixing.value, rows)
            yield pa.RecordBatch.from_arrays([b.column("_lm_id"), b.column("doc_id"), b.column("train"), b.column("n_bytes"), *map(pa.array, (n, in_head, base_head, logs))], names=["_lm_id", "doc_id", "train", "n_bytes", "n_tokens", "n_head", "base_head", "logs"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            at, word, k = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = Counter(t.split(b"\n")[:-1])
                at += [i] * len(c)
                word += c
                k += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(word, pa.binary()), pa.array(k, pa.int64())], names=["_lm_id", "word", "k"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = spelled.mapInArrow(run, f"_lm_id long, doc_id {id_type}, train boolean, n_bytes long, n_tokens long, n_head long, base_head double, logs double")
    # words outside the head are rare, each of them: their join has no hot key; equal words of a row were counted first
    c = F.coalesce("n", F.lit(0))
    rest = spelled.select("_lm_id", "tail").where(F.length("tail") > 0).mapInArrow(rare, "_lm_id long, word binary, k long").join(shares, "word", "left")
    rest = rest.groupBy("_lm_id").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k_known"), F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(total.n + total.v + 1)))).alias("base_tail"),
                                      F.sum(F.col("k") * F.log10(F.coalesce("share", F.lit(novel)))).alias("share"))
    own = scored.groupBy("_lm_id").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *(F.sum(x).alias(x) for x in ("n_bytes", "n_tokens", "n_head", "base_head", "logs")))
    points = F.col("logs") / F.lit(float(np.log(10))) + F.coalesce("share", F.lit(0.0))
    return own.join(rest, "_lm_id", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("k_known", F.lit(0))).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"), (F.col("base_head") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"),
        points.alias("score"), F.when(F.col("n_bytes") > 0, -points / float(np.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
