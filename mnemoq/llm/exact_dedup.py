"""Exact dedup by an extendible-hash index on shared files: a directory maps the first bits of a text's key to a
bucket, overfull buckets split in two, and the directory doubles where a bucket has as many bits as it. The tasks
that own the buckets chain colliding keys and compare bytes.

1. One narrow scan takes each text without white space, its SHA-256, and of that the first 64 bits as its key;
   these few bytes a row are stored. Keys are counted, each task's own copies first.
2. The directory grows in the driver from counts of keys by prefix (bounded by ``max_depth`` bits): a bucket with
   more than ``capacity`` keys splits by its next bit, until it fits or has ``max_depth`` bits; such a bucket holds
   more, which costs its owner time only, as buckets are read as a sorted stream. Every bucket is a range of keys.
3. Keys that occur again set a bit in a map of 2**30 bits at most, which is sent to the tasks; texts whose bit is
   not set are unique and stay where they are. Of the others (with those that share a bit by chance: one unique text
   in SPREAD, more where the map is at its bound), each task puts equal texts together, comparing bytes, and sends
   one of each to the bucket's owner. So a text of a third of all rows is one row a task.
4. An owner reads its buckets by key, compares texts of equal keys byte by byte, chains those that differ, and adds
   up those that are equal. Its entries (bucket, key, place in the chain, digest, size of the class, the row that
   stays) are the bucket files; directory and buckets lie in the shared folder as Parquet.
5. Each row finds its class by digest. The largest classes, up to ``max_broadcast``, are sent to the rows; members of
   the others meet them in a join, on some 60 bytes a row. Classes of one need neither.

Bytes decide which texts are equal. Rows find their class by SHA-256; two different texts with one digest would
be an error in the owner, not a wrong result.

Defined cases: null is the empty text, and all texts without any character but white space are equal; very long
texts are whole; of equal texts the one with the most code points stays, then the smallest doc_id, null ids last,
then the first row; rows of equal doc_id are rows of their own, of which one stays; an empty table gives no rows.
doc_id may be of any type that orders. Extra columns pass through ``keep_one``, whatever their names (but for the prefix ``_xd_``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, numbered, scratch, stored, table

SPACE = b" \t\n\x0b\x0c\r"
CAPACITY = 256  # keys in a bucket before it splits
MAX_DEPTH = 20  # bits of a directory
LEAST_BITS, MAX_BITS = 10, 30  # of the map of repeated keys
SPREAD = 16  # bits of the map for each repeated key
MAX_BROADCAST = 200_000
HELD = 32 << 20  # bytes of text that a task puts together before it sends them


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def _keys(digests: list[bytes], key_bits: int) -> np.ndarray:
    """The first bits of the digests as longs; the rest of 64 is 0."""
    k = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
    return (k & np.uint64((1 << 64) - (1 << (64 - key_bits)))).view(np.int64)


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


class Directory:
    """slots[k] is the bucket of the keys whose first ``depth`` bits are k; a bucket has its own number of bits, and
    owns 2**(depth - bits) slots in a row."""

    def __init__(self) -> None:
        self.depth, self.slots = 0, np.zeros(1, np.int32)
        self.bits, self.prefixes = [0], [0]

    def double(self) -> None:
        self.depth, self.slots = self.depth + 1, np.repeat(self.slots, 2)

    def split(self, b: int) -> int:
        """Give the upper half of a bucket's keys to a new bucket, and return its number."""
        if self.bits[b] == self.depth:
            self.double()
        self.bits[b] += 1
        self.prefixes[b] *= 2
        new, upper = len(self.bits), self.prefixes[b] + 1
        self.bits.append(self.bits[b])
        self.prefixes.append(upper)
        wide = self.depth - self.bits[b]
        self.slots[upper << wide : (upper + 1) << wide] = new
        return new

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int32)

    def insert(self, cells: np.ndarray, cell_bits: int, capacity: int) -> list[int]:
        """Split until no bucket has more than ``capacity`` of the keys counted by prefix; those that need more bits than the cells have."""
        until = np.concatenate([[0], np.cumsum(cells)])
        todo, stuck = list(range(len(self.bits))), []
        while todo:
            b = todo.pop()
            wide = cell_bits - self.bits[b]
            if until[(self.prefixes[b] + 1) << wide] - until[self.prefixes[b] << wide] > capacity:
                if wide:
                    todo += [b, self.split(b)]
                else:
                    stuck.append(b)
        return stuck


def grown(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> Directory:
    """The directory for distinct keys, from counts by prefix: 2**max_depth counts at most come to the driver."""
    out, n = Directory(), keys.count()
    bits = min(max_depth, (n // capacity).bit_length() + 4)
    while True:
        counts = keys.groupBy(prefix(F.col("key"), bits).alias("cell")).count().toArrow()
        cells = np.zeros(1 << bits, np.int64)
        cells[counts.column("cell").to_numpy()] = counts.column("count").to_numpy()
        if not out.insert(cells, bits, capacity) or bits == max_depth:
            return out
        bits = min(max_depth, bits + 4)


def repeated(keys: DataFrame, max_bits: int = MAX_BITS) -> tuple[np.ndarray, int]:
    """A map of 2**bits bits, one bit a byte's eighth, set for the keys with n > 1."""
    again = keys.where(F.col("n") > 1)
    bits = min(max_bits, max(LEAST_BITS, (again.count() * SPREAD).bit_length()))
    low = min(16, bits)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = np.zeros(1 << low, np.uint8)
                one[at] = 1
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(one, bitorder="little").tobytes()])], names=["piece", "bits"])

    at = prefix(F.col("key"), bits)
    sets = again.select(F.shiftright(at, low).alias("piece"), at.bitwiseAND(F.lit((1 << low) - 1)).cast("int").alias("at")).groupBy("piece").agg(F.collect_set("at").alias("at"))  # 2**16 places at most
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in sets.mapInArrow(packed, "piece long, bits binary").toLocalIterator():  # one map of bounded size
        out[r.piece << (low - 3) : (r.piece + 1) << (low - 3)] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def digests_of(docs: DataFrame, key_bits: int) -> DataFrame:
    """(_xd_row, _xd_id, _xd_chars, _xd_key, _xd_sha) of each row of (_xd_row, _xd_id, _xd_text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            text = pc.fill_null(b.column(2), "")
            sha = [hashlib.sha256(normalised(t)).digest() for t in text.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.utf8_length(text).cast(pa.int64()), pa.array(_keys(sha, key_bits)), pa.array(sha, pa.binary())], names=["_xd_row", "_xd_id", "_xd_chars", "_xd_key", "_xd_sha"])

    kind = docs.schema["_xd_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_xd_row long, _xd_id {kind}, _xd_chars long, _xd_key long, _xd_sha binary")


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, doc_id, row), the one that stays."""
    return min(a, b, key=lambda v: (-v[0], v[1] is None, v[1] if v[1] is not None else 0, v[2]))


@dataclass
class Index:
    """A built index: its folder, its directory, and the stored digests of the rows it was built from."""

    path: str
    directory: Directory
    rows: DataFrame

    @property
    def buckets(self) -> DataFrame:
        """(bucket, key, chain, sha, size, keep_id, keep_row, chars), a row for each text that differs from all others."""
        return self.rows.sparkSession.read.parquet(f"{self.path}/buckets")


def build(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, max_bits: int = MAX_BITS, key_bits: int = 64) -> Index:
    """The index of (_xd_row, _xd_id, _xd_text); ``key_bits`` under 64 makes keys collide, for tests."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "exact-index")
    rows = stored(digests_of(docs, key_bits), "exact-rows")
    keys = stored(rows.groupBy(F.col("_xd_key").alias("key")).agg(F.count("*").alias("n")), "exact-keys")
    directory = grown(keys, capacity, max_depth)
    slots = pa.table({"slot": pa.array(np.arange(len(directory.slots))), "bucket": pa.array(directory.slots), "bits": pa.array(np.array(directory.bits, np.int32)[directory.slots])})
    spark.createDataFrame(slots).write.parquet(f"{path}/directory")
    sent = spark.sparkContext.broadcast((directory, *repeated(keys, max_bits)))
    kind = docs.schema["_xd_id"].dataType.simpleString()
    id_type = docs.select("_xd_id").limit(0).toArrow().schema.field(0).type
    sent_type = [("bucket", pa.int32()), ("key", pa.int64()), ("text", pa.binary()), ("sha", pa.binary()), ("size", pa.int64()), ("chars", pa.int64()), ("keep_id", id_type), ("keep_row", pa.int64())]
    entry_type = [("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("size", pa.int64()), ("chars", pa.int64()), ("keep_id", id_type), ("keep_row", pa.int64())]

    def as_batch(out: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, (_, t) in enumerate(types)], names=[n for n, _ in types])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows for the owners: texts whose key comes again, equal ones put together; of the others the digest alone."""
        directory, bitmap, bits = sent.value
        held: dict[int, list[list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array(list(held), np.int64)
            where = dict(zip(held, directory.bucket_of(keys).tolist(), strict=True))
            out = [(where[k], k, text, sha, n, *best) for k, chain in held.items() for text, sha, n, best in chain]
            held.clear()
            return as_batch(out, sent_type)

        for b in batches_of(batches):
            texts = [normalised(t) for t in pc.fill_null(b.column(2), "").cast(pa.binary()).to_pylist()]
            sha = [hashlib.sha256(t).digest() for t in texts]
            keys = _keys(sha, key_bits)
            at = keys.view(np.uint64) >> np.uint64(64 - bits)
            again = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            chars = pc.utf8_length(pc.fill_null(b.column(2), "")).to_pylist()
            buckets, out = directory.bucket_of(keys).tolist(), []
            for i, (row, doc, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), keys.tolist(), strict=True)):
                best = (chars[i], doc, row)
                if not again[i]:
                    out.append((buckets[i], k, None, sha[i], 1, *best))
                    continue
                for e in held.setdefault(k, []):
                    if e[0] == texts[i]:
                        e[2], e[3] = e[2] + 1, _better(e[3], best)
                        break
                else:
                    held[k].append([texts[i], sha[i], 1, best])
                    size += len(texts[i]) + 200
            if out:
                yield as_batch(out, sent_type)
            if size > HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries of the buckets that come sorted by key: chains of the texts of one key, compared byte by byte."""
        key, chain, out = None, [], []

        def finish() -> None:
            if len({e[2] for e in chain}) < len(chain):
                raise ValueError("two different texts have one SHA-256")
            out.extend((e[1], key, j, e[2], e[3], *e[4]) for j, e in enumerate(chain))
            chain.clear()

        for b in batches_of(batches):
            for bucket, k, text, sha, n, chars, doc, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    finish()
                    key = k
                for e in chain:
                    if e[0] == text:
                        e[3], e[4] = e[3] + n, _better(e[4], (chars, doc, row))
                        break
                else:
                    chain.append([text, bucket, sha, n, (chars, doc, row)])
            if len(out) > 5000:
                yield as_batch(out, entry_type)
                out.clear()
        finish()
        if out:
            yield as_batch(out, entry_type)

    owned = docs.mapInArrow(put_together, f"bucket int, key long, text binary, sha binary, size long, chars long, keep_id {kind}, keep_row long")
    owned = owned.repartition("bucket").sortWithinPartitions("bucket", "key", "keep_row")  # the owner's first text of a key is the same each time
    owned.mapInArrow(own, f"bucket int, key long, chain int, sha binary, size long, chars long, keep_id {kind}, keep_row long").write.parquet(f"{path}/buckets")
    return Index(path, directory, rows)


def classes(docs: DataFrame, max_broadcast: int = MAX_BROADCAST, **how) -> DataFrame:
    """A row for each row of docs: _xd_row (as in docs, or numbered here), _xd_id (its doc_id), _xd_keep_id, _xd_size (of its
    class), _xd_kept, and _xd_sha (of the text without white space)."""
    base = docs if "_xd_row" in docs.columns else numbered(docs, "_xd_row")
    index = build(base.select("_xd_row", F.col("doc_id").alias("_xd_id"), F.col("text").alias("_xd_text")), **how)
    many = index.buckets.where(F.col("size") > 1).select(F.col("sha").alias("_xd_of"), "size", "keep_id", "keep_row")
    hot = stored(many.orderBy(F.desc("size"), "_xd_of").limit(max_broadcast), "exact-hot")
    rows = index.rows
    hit = rows.join(F.broadcast(hot), rows["_xd_sha"] == hot["_xd_of"], "left")
    if many.limit(max_broadcast + 1).count() > max_broadcast:
        rest = many.join(F.broadcast(hot.select("_xd_of")), "_xd_of", "left_anti")
        done, open_ = hit.where(F.col("_xd_of").isNotNull()), hit.where(F.col("_xd_of").isNull()).select(rows["*"])
        hit = done.unionByName(open_.join(rest, open_["_xd_sha"] == rest["_xd_of"], "left"))
    return hit.select("_xd_row", "_xd_id", F.when(F.col("_xd_of").isNull(), F.col("_xd_id")).otherwise(F.col("keep_id")).alias("_xd_keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("_xd_size"), F.coalesce(F.col("keep_row") == F.col("_xd_row"), F.lit(True)).alias("_xd_kept"), "_xd_sha")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs, the same columns, without the rows whose text equals that of a row which stays."""
    base = numbered(docs, "_xd_row")
    gone = classes(base, **how).where(~F.col("_xd_kept")).select("_xd_row")
    return base.join(gone, "_xd_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_xd_id").alias("doc_id"), F.col("_xd_keep_id").alias("keep_id"), F.col("_xd_size").alias("group_size"), F.col("_xd_kept").alias("kept"), F.lower(F.hex("_xd_sha")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS t FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS place, count(*) OVER (PARTITION BY t) AS size,
             first_value(doc_id) OVER (PARTITION BY t ORDER BY chars DESC, doc_id) AS keep FROM n)
SELECT doc_id, keep AS keep_id, size::BIGINT AS group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM k
"""
