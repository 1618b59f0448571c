"""Token ids in files: a canonical Huffman code of limited length from the ids' global counts, and
blocks that decode on their own, each with the bit offsets of regular checkpoints.

Steps: every text is encoded once into a table in the shared folder; ids are counted by task, then in
all; one code is made from the counts (its size is the vocabulary's); rows are coded, dealt by ranges
of doc_id and put together as blocks, in ascending order. The code's lengths and the parameters are
written beside the blocks, so a reader in another process needs the path alone.

A block is a row of a Parquet table, which any store that Spark reaches can hold: ``part`` and
``block`` (its place), ``start`` (ids in all blocks before it), the doc_ids, the ids of each document,
the bit offset at every ``every``-th id, and the bits. Decoding looks up ``limit`` bits at a time in a
table of 2**limit entries, for all checkpoints of a block side by side.

A code has ``limit`` bits at most, or as many as the distinct ids need, up to MOST_BITS.

Defined cases: null text is empty and is the end id alone; very long texts are whole, each within one block; an empty table gives no blocks and no
rows; rows of equal doc_id follow each other in the order of their coded bytes; a null doc_id comes first;
a doc_id that is no whole number is an error; only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, forget, scratch, stored, table
from .tokens import default_path, encoder

END = 2
LIMIT = 16  # bits of the longest code; more where a vocabulary needs more
MOST_BITS = 25
EVERY = 64
BLOCK_IDS = 1 << 16


# ---- the code ------------------------------------------------------------------------------------
def lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Code lengths of least total for these counts, none over limit (package-merge)."""
    if len(counts) > 1 << limit:
        raise ValueError("more symbols than codes")
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    leaves = sorted((c, (s,)) for s, c in counts.items())
    symbols = [s for _, (s,) in leaves]
    weights = np.array([c for c, _ in leaves], np.int64)
    # each level is kept as: which of its entries are leaves; the packages taken are always a prefix
    levels, row = [], weights
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        row = both[order]
    out, take = np.zeros(len(weights), np.int64), 2 * (len(weights) - 1)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        out[:n] += 1
        take = 2 * (take - n)
    out[:take] += 1
    return dict(zip(symbols, out.tolist(), strict=True))


def canonical(length: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) indexed by symbol; codes ascend by (length, symbol)."""
    size = max(length, default=0) + 1
    codes, lens = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
    code, last = 0, 0
    for n, s in sorted((n, s) for s, n in length.items()):
        code <<= n - last
        codes[s], lens[s], last = code, n, n
        code += 1
    return codes, lens


def pack(ids: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, padded to bytes, and the bit offset of each id. Codes have 32 bits at most."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = lens[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts, total = ends - n, int(ends[-1])
    # a code lies in the 64 bits from the 32-bit word in which it starts; codes that start in the same word are or-ed first
    word = starts >> 5
    bits = codes[ids].astype(np.uint64) << (64 - n - (starts & 31)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    bits, word = np.bitwise_or.reduceat(bits, first), word[first]
    out = np.zeros((total >> 5) + 2, np.uint32)
    out[word] |= (bits >> np.uint64(32)).astype(np.uint32)
    out[word + 1] |= (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], starts


class Decoder:
    def __init__(self, length: dict[int, int], limit: int):
        codes, lens = canonical(length)
        self.limit = limit
        self.symbol, self.length = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.int64)
        for s, n in length.items():
            first = int(codes[s]) << (limit - n)
            self.symbol[first : first + (1 << (limit - n))] = s
            self.length[first : first + (1 << (limit - n))] = n

    def read(self, bits: bytes, n_ids: int, marks: np.ndarray, every: int) -> np.ndarray:
        """The ids of a block; all checkpoints are decoded side by side, an id of each at a time."""
        data = np.frombuffer(bits + b"\0\0\0\0", np.uint8).astype(np.uint32)
        wide = 24 if self.limit <= 17 else 32
        word = (data[:-3] << 16) | (data[1:-2] << 8) | data[2:-1]  # 24 bits from each byte on
        if wide == 32:
            word = (word << 8) | data[3:]
        out = np.zeros(len(marks) * every, np.uint32)
        at = marks.astype(np.int64).copy()
        mask = np.uint32((1 << self.limit) - 1)
        last = len(word) - 1
        for i in range(every):
            look = (word[np.minimum(at >> 3, last)] >> (wide - self.limit - (at & 7)).astype(np.uint32)) & mask
            out[i::every] = self.symbol[look]
            at += self.length[look]
        return out[:n_ids]


# ---- jobs ----------------------------------------------------------------------------------------
def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text, then the end id, as bytes; one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end], enc.dtype).tobytes()
        for b in batches_of(batches):
            got = [x + tail for x in enc.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // enc.dtype.itemsize for x in got], pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def count_ids(tokens: DataFrame, wide: bool) -> dict[int, int]:
    """How often each id occurs; at most a vocabulary of rows reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4" if wide else "<u2"))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total[: len(c)] += c
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    return dict(sorted(zip(rows.column("id").to_pylist(), rows.column("n").to_pylist(), strict=True)))


def _ranges(tokens: DataFrame, parts: int) -> list[int]:
    """Bounds of doc_id between which about equally many documents lie."""
    qs = tokens.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(q) for q in qs})


def ranged(tokens: DataFrame, bounds: list[int]) -> DataFrame:
    """tokens with part: the number of bounds at or below the doc_id, looked up in the sorted bounds batch by batch; null is before all."""
    sent = tokens.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            part = np.searchsorted(sent.value, ids.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
            yield b.append_column("part", pa.array(part))

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("part", T.IntegerType())]))


def save_code(spark: SparkSession, to: str, length: dict[int, int], limit: int, every: int, end: int) -> None:
    """The code's lengths and the parameters, as a table beside the blocks: all that a reader needs to know."""
    rows = pa.table({"symbol": pa.array(list(length), pa.int64()), "bits": pa.array(list(length.values()), pa.int32())})
    spark.createDataFrame(rows, "symbol long, bits int").coalesce(1).withColumns({"limit": F.lit(limit), "every": F.lit(every), "end": F.lit(end)}).write.parquet(f"{to}/code")


def load_code(spark: SparkSession, path: str) -> tuple[dict[int, int], int, int]:
    """(lengths, limit, every) of the files at a path; a row for each id that occurs."""
    rows = spark.read.parquet(f"{path}/code").collect()
    return {r.symbol: r.bits for r in rows}, *((rows[0].limit, rows[0].every) if rows else (LIMIT, EVERY))


def write(docs: DataFrame, path: str | None = None, end: int = END, limit: int = LIMIT, every: int = EVERY, to: str | None = None) -> str:
    """Write the ids of docs in ascending doc_id order, as blocks and their code; returns the path, all that ``read`` needs."""
    spark = docs.sparkSession
    path = path or default_path()
    wide = encoder(path).dtype.itemsize == 4
    tokens = stored(encoded(docs, path, end), "token-ids")
    counts = count_ids(tokens, wide)
    limit = max(limit, (len(counts) - 1).bit_length())  # as many bits as the ids need
    if limit > MOST_BITS:
        raise ValueError(f"{len(counts)} distinct ids need codes of more than {MOST_BITS} bits")
    length = lengths(counts, limit) if counts else {}
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _ranges(tokens, parts)
    sums = {r.part: r.n for r in ranged(tokens.select("doc_id", "n"), bounds).groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    base, before = {}, 0
    for k in range(len(bounds) + 1):
        base[k] = before
        before += sums.get(k, 0)
    sent = spark.sparkContext.broadcast((length, base, np.array(bounds, np.int64)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lens = canonical(sent.value[0])
        for b in batches:
            bits, marks = [], []
            for x in b.column("ids").to_pylist():
                y, at = pack(np.frombuffer(x, "<u4" if wide else "<u2"), codes, lens)
                bits.append(y)
                marks.append(at[::every].astype("<u4").tobytes() if len(y) < 1 << 28 else at[::every].astype("<u8").tobytes())
            ids = b.column("doc_id")
            part = np.searchsorted(sent.value[2], ids.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), ids, b.column("n"), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())], names=["part", "doc_id", "n", "bits", "marks"])

    schema = "part int, doc_id long, n long, bits binary, marks binary"
    coded = tokens.mapInArrow(code, schema).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "bits")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, block, now, held = 0, 0, None, 0

        def flush():
            ids, ns, bits, marks, n_bits, part = now
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ns], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.list_(pa.int64()))), pa.array([b"".join(bits)], pa.binary())],
                names=["part", "block", "start", "doc_ids", "n_ids", "checkpoints", "bits"])

        for b in batches:
            for p, d, n, y, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[5] != p:
                    if now is not None:
                        yield flush()
                    start, block, now, held = sent.value[1][p], 0, [[], [], [], [], 0, p], 0
                elif held >= BLOCK_IDS:
                    yield flush()
                    start, block, now, held = start + held, block + 1, [[], [], [], [], 0, p], 0
                held += n
                now[0].append(d)
                now[1].append(n)
                now[2].append(y)
                now[3].append((np.frombuffer(m, "<u4" if len(y) < 1 << 28 else "<u8").astype(np.int64) + now[4]).tolist())
                now[4] += 8 * len(y)
        if now is not None:
            yield flush()

    files = coded.mapInArrow(blocks, "part int, block int, start long, doc_ids array<long>, n_ids array<long>, checkpoints array<array<long>>, bits binary")
    to = to or scratch(spark, "huffman-blocks")
    files.write.parquet(f"{to}/blocks")
    save_code(spark, to, length, limit, every, end)
    forget(tokens)
    return to


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files at a path alone. ids are left out on demand."""
    blocks = spark.read.parquet(f"{path}/blocks")
    length, limit, every = load_code(spark, path)
    sent = spark.sparkContext.broadcast(length)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value, limit)
        for b in batches_of(batches, 16):
            for start, docs, ns, marks, bits in zip(*(b.column(c).to_pylist() for c in ("start", "doc_ids", "n_ids", "checkpoints", "bits")), strict=True):
                at = np.array([x for m in marks for x in m], np.int64)
                ids = decoder.read(bits, len(at) * every, at, every)
                out, crc, seqs, row = [], [], [], 0
                for n, m in zip(ns, marks, strict=True):
                    own = ids[row : row + n].astype("<u4")
                    row += len(m) * every  # a document's last checkpoint may be short; what lies past it is not read
                    out.append(start)
                    crc.append(zlib.crc32(own.tobytes()))
                    seqs.append(own.astype(np.int32))
                    start += n
                cols = [pa.array(docs, pa.int64()), pa.array(out, pa.int64()), pa.array(ns, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(seqs, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.mapInArrow(run, schema)


def op6_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(table(spark, sf_dir, "documents").select("doc_id", "text")), with_ids=False)
