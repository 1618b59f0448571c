"""Line dedup: two Bloom filters, for line hashes seen once and seen twice; only lines suspected of
a repeat are shuffled, for exact confirmation and for the choice of the occurrence that stays.

1. One narrow scan hashes the long lines of every document (128 bits, DataFrame functions); the hashes,
   a few per cent of the text, are stored by document. The filters work on that table alone.
2. Every task makes two bit maps from its documents: seen, and seen in another document again. Pieces
   of the maps are merged by position, in a stream: a bit of the second map is set where either side
   has it or both sides have the first. So each line of two documents has all its bits in the merged
   second map; other lines may too, by chance, which costs time only.
3. Lines whose bits are all set there are suspects. Each task sends at most ``min_docs`` doc_ids of a
   suspect, and the largest, so a line of a third of all documents is a few rows a task. Keys in
   ``min_docs`` documents or more are confirmed by an exact count, with the document that keeps them.
4. Lines of confirmed keys are dropped in all other documents, in the scan of the texts; texts without
   one pass as they are. The confirmed keys are broadcast up to ``max_broadcast``; beyond it only the
   commonest are, and the others meet the stored hashes in a join, by key.

A map has BITS_A_LINE bits for each long line, so that about one once-only line in thirty is a
suspect at every size. Where that is over 2**max_bits, the stored hashes are dealt into slices by
prefix, and each slice goes through its own two filters of that size, one after the other: its suspects are
written down and its map is destroyed before the next one is made.

"Exact" is the count, by key: keys are compared by 128 bits of MD5, not by their text.

Defined cases: null or empty text is one empty line; very long texts are whole rows of lines, none is cut; short
keys are never touched; rows of equal doc_id are one document, for the count and for the choice; a null
doc_id is one document and never the one that keeps a line; doc_id may be of any type that orders, and the largest
is so in that order (of strings: by code points); an empty table gives no rows. Extra columns
pass through ``dedup``, whatever their names (but for the prefix ``_ld_``); n_chars, if there, is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, batches_of, fenced, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
BITS_A_LINE = 8
LEAST_BITS, MAX_BITS = 20, 30  # a map has 2**20 bits at least, and 2**30 (128 MB) at most
PIECE = 1 << 13  # bytes of a map in one row
PROBES = 3
MAX_BROADCAST = 200_000
SPACE = " \t\n\x0b\x0c\r"


def keys_of(text: Column, min_chars: int) -> Column:
    """One entry per line: the 128-bit hash of the line's key, null if the key is too short to count."""
    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(SPACE))
        return F.when(F.length(line) >= min_chars, F.when(F.length(k) >= min_chars, F.unhex(F.md5(ascii_lower(k).cast("binary")))))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), key)


def _halves(keys: pa.Array) -> np.ndarray:
    """The two 64-bit halves of 16-byte keys, a row each."""
    flat = keys.cast(pa.binary(16)) if len(keys) else pa.array([], pa.binary(16))
    return np.frombuffer(flat.buffers()[1], "<u8", count=2 * len(flat), offset=16 * flat.offset).reshape(-1, 2) if len(flat) else np.zeros((0, 2), np.uint64)


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """A row of bit numbers for each key."""
    i = np.arange(PROBES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return ((h[:, :1] + i * (h[:, 1:] | np.uint64(1))) >> np.uint64(8)) & np.uint64((1 << bits) - 1)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _squeezed(part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)


def twice_seen(hashes: DataFrame, bits: int) -> np.ndarray:
    """The merged second map, of 2**(bits - 3) bytes, from (doc_id, keys), keys distinct in each row."""
    size = 1 << (bits - 3)
    piece = min(PIECE, size)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for b in batches:
            # keys of the same batch may repeat, too: the repeats go straight to the second map
            h = _halves(b.column(0).flatten())
            if not len(h):
                continue
            order = np.lexsort((h[:, 1], h[:, 0]))
            h = h[order]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]).all(axis=1)
            at = probes(h, bits)
            _set(twice, at[_has(once, at) | again])
            _set(once, at)
        for k in range(0, size, piece):
            if once[k : k + piece].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), pa.array([_squeezed(once[k : k + piece])]), pa.array([_squeezed(twice[k : k + piece])])], names=["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = _unsqueezed(x, piece), _unsqueezed(y, piece)
                m = maps.setdefault(k, [np.zeros(piece, np.uint8), np.zeros(piece, np.uint8)])
                m[1] = m[1] | y | (m[0] & x)
                m[0] = m[0] | x
        for k, (_, y) in maps.items():
            if y.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_squeezed(y)])], names=["piece", "twice"])

    parts = hashes.select("keys").mapInArrow(build, "piece int, once binary, twice binary").repartition("piece")
    out = np.zeros(size, np.uint8)
    for r in parts.mapInArrow(merge, "piece int, twice binary").toLocalIterator():  # one map in all, of bounded size
        out[r.piece * piece : (r.piece + 1) * piece] = _unsqueezed(r.twice, piece)
    return out


def suspects(hashes: DataFrame, bits: int, min_docs: int) -> tuple[DataFrame, Broadcast]:
    """(key, doc_id) of the keys whose bits are all set, of each key at most min_docs doc_ids, and the largest, a task; and
    the map that was sent for it, to be destroyed once the rows are written."""
    sent = hashes.sparkSession.sparkContext.broadcast(twice_seen(hashes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, kind = sent.value, {}, pa.null()

        def rows():
            keys, ids = [], []
            for k, d in seen.items():
                keys += [k] * len(d)
                ids += d
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, kind)], names=["key", "doc_id"])

        for b in batches:
            lists, ids = b.column("keys"), b.column("doc_id")
            flat, kind = lists.flatten(), ids.type
            if not len(flat):
                continue
            hit = np.flatnonzero(_has(bitmap, probes(_halves(flat), bits)))
            parent = pc.list_parent_indices(lists).take(pa.array(hit))
            for k, d in zip(flat.take(pa.array(hit)).to_pylist(), ids.take(parent).to_pylist(), strict=True):
                had = seen.setdefault(k, [])
                if d in had:
                    continue
                if len(had) < min_docs:
                    had.append(d)
                elif d is not None and (m := max((x for x in had if x is not None), default=d)) < d:
                    had[had.index(m)] = d  # the largest so far gives way: as many are left, and the new one is largest
            if len(seen) > 200_000:
                yield rows()
        if seen:
            yield rows()

    return hashes.select("keys", "doc_id").mapInArrow(run, T.StructType([T.StructField("key", T.BinaryType()), hashes.schema["doc_id"]])), sent


def hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, keys): the distinct keys of the documents' long lines, for documents that have any."""
    keys = F.array_distinct(F.filter(keys_of(F.col("text"), min_chars), lambda k: k.isNotNull()))
    return fenced(docs.select("doc_id", keys.alias("keys")), F.size("keys") > 0).select("doc_id", "keys")


def confirmed(hashes: DataFrame, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, keep, n): the keys that are in min_docs documents, the largest doc_id that holds each, and
    how many of its documents were sent (as an order of how common it is)."""
    lines = hashes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).cast("long").alias("n")).first().n
    bits = max(LEAST_BITS, (max(1, lines * BITS_A_LINE) - 1).bit_length())
    slices = 1 << max(0, bits - max_bits)
    parts = [hashes]
    if slices > 1:
        by = F.expr(f"cast(conv(hex(substr(key, 13, 4)), 16, 10) as bigint) % {slices}").cast("int")  # the bits' numbers come from elsewhere
        dealt = stored(hashes.select("doc_id", F.explode("keys").alias("key")).select("doc_id", F.array("key").alias("keys"), by.alias("slice")), "line-slices", by="slice")
        parts = [dealt.where(F.col("slice") == s).select("doc_id", "keys") for s in range(slices)]
    out = None
    for p in parts:
        found, sent = suspects(p, min(bits, max_bits), min_docs)
        if slices > 1:  # one map at a time: its suspects are written down before the next one is made
            found = stored(found, "line-suspects")
            sent.destroy()
        out = found if out is None else out.union(found)
    pairs = out.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("key").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs).select("key", "keep", "n")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with text (lines dropped), and, as the last two columns, _ld_lines (before) and _ld_dropped."""
    spark = docs.sparkSession
    hashes = stored(hashed(docs, min_chars), "line-hashes")
    keys = stored(confirmed(hashes, min_docs, max_bits), "line-keys")
    hot = keys.orderBy(F.desc("n"), "key").limit(max_broadcast).select("key", "keep").toArrow()  # bounded
    sent = spark.sparkContext.broadcast(dict(zip(hot.column("key").to_pylist(), hot.column("keep").to_pylist(), strict=True)))
    base = docs.withColumn("_ld_keys", keys_of(F.col("text"), min_chars))
    if keys.limit(max_broadcast + 1).count() > max_broadcast:
        rest = keys.join(F.broadcast(spark.createDataFrame(hot.select(["key"]))), "key", "left_anti") if len(hot) else keys
        mine = hashes.select("doc_id", F.explode("keys").alias("key")).join(rest, "key").where(~F.col("doc_id").eqNullSafe(F.col("keep")))
        mine = mine.groupBy(F.col("doc_id").alias("_ld_doc")).agg(F.collect_set("key").alias("_ld_rare"))
        base = base.join(mine, base["doc_id"].eqNullSafe(mine["_ld_doc"]), "left").drop("_ld_doc")
    else:
        base = base.withColumn("_ld_rare", F.lit(None).cast("array<binary>"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_ld_lines", T.LongType()), T.StructField("_ld_dropped", T.LongType())])
    doc_at, text_at = names.index("doc_id"), names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_at = sent.value
        for b in batches_of(batches):
            lists, rares, ids = b.column(len(names)), b.column(len(names) + 1), b.column(doc_at)
            n_lines = pc.list_value_length(lists).cast(pa.int64())
            flat, of, gone = lists.flatten(), pc.list_parent_indices(lists).to_numpy(), np.zeros(b.num_rows, np.int64)
            long_at = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
            drop: dict[int, list[int]] = {}
            begin = np.cumsum(n_lines.to_numpy()) - n_lines.to_numpy()
            rare = {i: (set(rares[i].as_py())) for i in np.flatnonzero(rares.is_valid().to_numpy(zero_copy_only=False)).tolist()}
            doc = ids.to_pylist()
            for at, i, k in zip(long_at.tolist(), of[long_at].tolist(), flat.take(pa.array(long_at)).to_pylist(), strict=True):
                if k in keep_at and keep_at[k] != doc[i] or i in rare and k in rare[i]:
                    drop.setdefault(i, []).append(at - int(begin[i]))
            texts = b.column(text_at)
            if drop:
                new = texts.to_pylist()
                for i, lines in drop.items():
                    gone[i], out = len(lines), set(lines)
                    new[i] = "\n".join([x for j, x in enumerate(new[i].split("\n")) if j not in out])
                texts = pa.array(new, texts.type)
            cols = [texts if j == text_at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, n_lines, pa.array(gone)], names=[*names, "_ld_lines", "_ld_dropped"])

    return base.mapInArrow(apply, schema)


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs, the same columns and rows, without the repeated lines; n_chars follows the text."""
    out = drop_lines(docs, **how)
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, s[i] AS line, translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
r AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keep IS NOT NULL AND keep <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT (keep IS NOT NULL AND keep <> doc_id)), '')) AS kept_sha256
FROM l LEFT JOIN r USING (k) GROUP BY doc_id
"""
