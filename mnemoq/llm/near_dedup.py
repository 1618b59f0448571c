"""MinHash near-dedup: bottom-k sketches from one hash function. Inverted lists of retained values
generate overlaps, union sketches filter them, exact Jaccard on the full sets verifies them.

1. Each document's distinct word shingles are hashed once (64 bits); the ``K`` least hashes are its
   sketch. Documents of equal sets are one from here on, so exact copies cost nothing more.
2. Of the ``INDEXED`` least values, two sets of similarity 0.75 share 18 on average and fewer than
   ``SHARED`` once in about a million pairs. So only the INDEXED - SHARED + 1 values of each
   document which the fewest others hold need a place in the inverted lists (prefix filtering).
   Values of a passage that many documents share come last in that order and mostly get none.
   Sets so small that every similar one is listed whole (18 values of 24) go by their exact share.
3. Lists are not expanded into pairs. Each member is first compared with one pivot of its list, the
   member whose values are the most widely held. The links found make components. Lists whose
   members lie in one component are done. In the others the members outside the largest component
   meet all members of other components, in tiles of bounded size, so no link between different
   texts is lost and no task holds a whole list. A tile compares a pair only if this is the first list
   that both are in, and returns the links that join two components, so fewer rows than it has read.
   Tiles are gone through twice: by sketches, which tell what may have a partner; then these rows alone
   by their full sets.
4. Every comparison goes by union sketch first, then by the full sets.
5. Components: the least label of the neighbours, then the label's label, until nothing changes.

Defined cases: null or blank texts have no shingles and are linked with nothing; texts shorter than a
shingle are one shingle; doc_id is the key, so rows that share a doc_id share a component; an empty
table gives no rows; extra columns are ignored, or kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, forget, stored, table

SHINGLE = 5
PERCENT = 75
K = 64
INDEXED, SHARED = 24, 7
ESTIMATE = 0.52  # union sketches below this are 4.2 standard deviations under 0.75
TILE = 1024
SMALL = 48  # rows of a tile up to which all its pairs are looked at together with those of other tiles
MAX_BROADCAST = 500_000  # ids of listed documents, up to which they are sent to the scan; beyond, both sides are shuffled

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted hashes of a text's distinct shingles; word hashes are kept in a dict of bounded size."""

    def __init__(self, size: int, keep: int = 300_000):
        self.size, self.keep, self.words = size, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        known = self.words
        if len(known) > self.keep:
            known.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        for w in set(words):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - n + 1, np.uint64(n))
            for i in range(n):
                out = _mix(out * _M1 + h[i : len(words) - n + 1 + i])
        return np.unique(out)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, set_id, low, sketch): low are the INDEXED least hashes, sketch the first 32 bits of the K least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for b in batches_of(batches):
            sets = [of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]),
                 pa.array([s[:INDEXED].view(np.int64).tolist() for s in sets], pa.list_(pa.int64())), pa.array([(s[:K] >> np.uint64(32)).astype("<u4").tobytes() for s in sets])],
                names=["doc_id", "n", "set_id", "low", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set_id binary, low array<long>, sketch binary")


def _padded(rows: list[bytes]) -> np.ndarray:
    out = np.full((len(rows), K), 0xFFFFFFFF, np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 4] = np.frombuffer(r, "<u4")
    return out


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of the union's K least values which both have, row by row."""
    s = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = s != 0xFFFFFFFF
    twin = np.zeros(s.shape, bool)
    twin[:, 1:] = (s[:, 1:] == s[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1)
    return (twin & (rank <= K)).sum(axis=1) / np.maximum(1, np.minimum(rank[:, -1], K))


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def inverted(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, values, centre): the values under which a document is listed, none of them its own alone."""
    v = reps.select("doc_id", "n", F.explode("low").alias("value"))
    df = v.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = v.join(df, "value")  # values that one document alone holds go; they still count in the prefix, below
    # where no similar set can pass INDEXED values, both are known whole and the share may be counted exactly;
    # a larger partner lists its least INDEXED values alone, and what both share beyond them is in no list
    share = f"cast(ceil({percent} * n / 100.0) as int)"
    need = F.expr(f"if(100 * n <= {percent * INDEXED}, {share}, least({SHARED}, {share}))")
    own = shared.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"), F.sum("df").alias("centre"))
    place = F.least(F.col("n"), F.lit(INDEXED)) - need + 1  # the prefix's length
    alone = F.least(F.col("n"), F.lit(INDEXED)) - F.size("v")  # values of it that no other document holds
    own = own.withColumn("v", F.slice("v", F.lit(1), F.greatest(place - alone, F.lit(0)).cast("int")))
    return own.select("doc_id", F.col("v.value").alias("values"), "centre").where(F.size("values") > 0)


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (a, na, sa, b, nb, sb) that may be similar by size and union sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, sa, b, nb, sb = batch.columns
            ok = _sizes_fit(na.to_numpy(), nb.to_numpy(), percent)
            at = np.nonzero(ok)[0]
            if len(at):
                x, y = _padded(sa.take(pa.array(at)).to_pylist()), _padded(sb.take(pa.array(at)).to_pylist())
                at = at[similar(x, y) >= ESTIMATE]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    return rows.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    both = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "hashes": "ha"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "hashes": "hb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component): the least doc_id that is reachable; only documents with a link are listed."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        old = labels
        # the neighbours' least label, then the label that this document has itself
        step = edges.join(old.withColumnsRenamed({"doc_id": "b", "component": "l"}), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("l").alias("l"))
        step = step.join(old, "doc_id").select("doc_id", F.least("l", "component").alias("l"), F.col("component").alias("was"))
        jump = old.select(F.col("doc_id").alias("l"), F.col("component").alias("further"))
        labels = stored(step.join(jump, "l", "left").select("doc_id", F.least("l", F.coalesce("further", "l")).alias("component"), "was"), "labels")
        changed = labels.where("component <> was").limit(1).count()
        labels = labels.drop("was")
        forget(old)
        if not changed:
            forget(edges)
            return labels


def _holders(sk: np.ndarray) -> dict[int, np.ndarray]:
    """Sketch values that several rows hold, with these rows."""
    holders: dict[int, list[int]] = {}
    for i, row in enumerate(sk.tolist()):
        for x in row:
            if x != 0xFFFFFFFF:
                holders.setdefault(x, []).append(i)
    return {x: np.array(h) for x, h in holders.items() if len(h) > 1}


def _possible(i: int, sk: np.ndarray, ns: np.ndarray, holders: dict[int, np.ndarray], open_: np.ndarray, percent: int) -> np.ndarray:
    """The open rows that may be similar to row i by size and union sketch."""
    both = [holders[x] for x in sk[i].tolist() if x in holders]
    if not both:
        return np.zeros(0, np.int64)
    same = np.bincount(np.concatenate(both), minlength=len(ns))
    most = np.maximum(ns, ns[i])
    least = np.where(most <= K, -(-percent * most // 100), 26)  # of 64 values 48 are shared on average
    j = np.nonzero((same >= least) & open_ & _sizes_fit(ns, ns[i], percent))[0]
    return j[similar(np.broadcast_to(sk[i], (len(j), K)), sk[j]) >= ESTIMATE] if len(j) else j


def dealt_tiles(listed: DataFrame, first: DataFrame) -> DataFrame:
    """(value, kind, i, j, doc_id, component): the tiles of lists whose members lie in several components."""
    placed = listed.join(first, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    entries = placed.select(F.explode("values").alias("value"), "doc_id", "component")
    per = entries.groupBy("value", "component").agg(F.count("*").alias("m"))
    lists = per.groupBy("value").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    lists = lists.where("all > top.m").select("value", F.col("top.component").alias("main"), F.expr(f"cast(ceil(top.m / {TILE}) as int)").alias("ta"), F.expr(f"cast(ceil((all - top.m) / {TILE}) as int)").alias("tb"))
    e = entries.join(lists, "value").withColumn("inner", F.col("component") == F.col("main"))
    e = e.withColumn("k", F.when(F.col("inner"), F.expr("cast(pmod(xxhash64(doc_id), ta) as int)")).otherwise(F.expr("cast(pmod(xxhash64(doc_id), tb) as int)")))
    # a tile is two chunks: one of the main component and one of the others, or two of the others
    mine = "if(inner, transform(sequence(0, tb - 1), j -> struct(0 as kind, k as i, j as j)), concat(transform(sequence(0, ta - 1), i -> struct(0 as kind, i as i, k as j)), transform(sequence(0, tb - 1), j -> struct(1 as kind, least(k, j) as i, greatest(k, j) as j))))"
    return e.select("value", "doc_id", "component", F.explode(F.expr(mine)).alias("t")).select("value", "t.*", "doc_id", "component")


_KEY = ["value", "kind", "i", "j"]


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole tiles, with the tiles' first rows and the end; what a batch cuts off waits for the next one."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in _KEY:
            x = t[c].to_numpy()
            new |= x[1:] != x[:-1]
        starts = np.concatenate([[0], np.nonzero(new)[0] + 1])
        rest = t.slice(starts[-1]).combine_chunks()
        if len(starts) > 1:
            yield t.slice(0, starts[-1]).combine_chunks(), starts
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _small_pairs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within the tiles of up to SMALL rows."""
    m, a, b = np.diff(starts), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(m[(m > 1) & (m <= SMALL)]):
        x, y = np.triu_indices(k, 1)
        at = starts[:-1][m == k][:, None]
        a.append((at + x).ravel())
        b.append((at + y).ravel())
    return np.concatenate(a), np.concatenate(b)


def promising(dealt: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """The rows of the tiles which by their sketches may be similar to a row of another component in the same tile. Most tiles
    are of a few rows, so a task goes through its tiles in Arrow batches of many: small ones together, large ones row by row."""

    def large(value: int, kind: int, ns: np.ndarray, comp: np.ndarray, values: list[set[int]], sk: np.ndarray) -> np.ndarray:
        name, at = np.unique(comp, return_inverse=True)
        holders, biggest, found = _holders(sk), np.bincount(at).argmax(), np.zeros(len(ns), bool)
        for i in range(len(ns)):
            if kind == 0 and at[i] == biggest:
                continue  # its pairs are looked at from the other side
            # pairs of two rows that were found already tell nothing new
            for k in _possible(i, sk, ns, holders, (at != at[i]) & ~(found & found[i]), percent).tolist():
                if min(values[i] & values[k], default=None) == value:
                    found[i] = found[k] = True
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_tiles(batches):
            ns, comp, value, kind = (t[c].to_numpy() for c in ("n", "component", "value", "kind"))
            values, sk, found = [set(v) for v in t["values"].to_pylist()], _padded(t["sketch"].to_pylist()), np.zeros(t.num_rows, bool)
            a, b = _small_pairs(starts)
            ok = (comp[a] != comp[b]) & _sizes_fit(ns[a], ns[b], percent)
            a, b = a[ok], b[ok]
            here = np.fromiter((min(values[x] & values[y], default=None) == v for x, y, v in zip(a.tolist(), b.tolist(), value[a].tolist(), strict=True)), bool, len(a))
            a, b = a[here], b[here]
            for k in range(0, len(a), 8192):
                x, y = a[k : k + 8192], b[k : k + 8192]
                near = similar(sk[x], sk[y]) >= ESTIMATE
                found[x[near]] = found[y[near]] = True
            for k in np.nonzero(np.diff(starts) > SMALL)[0]:
                u = slice(starts[k], starts[k + 1])
                found[u] = large(value[starts[k]], kind[starts[k]], ns[u], comp[u], values[u], sk[u])
            yield from t.select([*_KEY, "doc_id", "component"]).filter(pa.array(found)).to_batches()

    rows = dealt.join(listed.select("doc_id", "values", "n", "sketch"), "doc_id").select(*_KEY, "doc_id", "component", "values", "n", "sketch")
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, "value long, kind int, i int, j int, doc_id long, component long")


def _tiles(listed: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the listed that join components of a list. Full sets go only to rows that have a partner by sketch."""
    found = stored(promising(dealt_tiles(listed, first), listed, percent), "found")

    def run(key, t):  # at most two chunks
        ids, ns, comp = t["doc_id"].to_numpy(), t["n"].to_numpy(), t["component"].to_numpy()
        values, sets_ = [set(v) for v in t["values"].to_pylist()], t["hashes"]
        sk = _padded([(np.frombuffer(s.as_py(), np.uint64)[:K] >> np.uint64(32)).astype("<u4").tobytes() for s in sets_])
        value, kind = key[0].as_py(), key[1].as_py()
        name, at = np.unique(comp, return_inverse=True)
        root, full = at.copy(), {}
        of = lambda i: full[i] if i in full else full.setdefault(i, np.frombuffer(sets_[i].as_py(), np.uint64))
        holders, biggest = _holders(sk), np.bincount(at).argmax()
        a, b = [], []
        for i in range(len(ids)):
            if kind == 0 and at[i] == biggest:
                continue  # its pairs are looked at from the other side
            for k in _possible(i, sk, ns, holders, root[at] != root[at[i]], percent).tolist():
                if root[at[k]] == root[at[i]] or min(values[i] & values[k], default=None) != value:
                    continue
                x, y = of(i), of(k)
                n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * n >= percent * (len(x) + len(y) - n):
                    a.append(ids[i])
                    b.append(ids[k])
                    root[root == root[at[k]]] = root[at[i]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = found.join(listed.select("doc_id", "values", "n"), "doc_id").join(sets, "doc_id").select("value", "kind", "i", "j", "doc_id", "component", "values", "n", "hashes")
    return rows.groupBy("value", "kind", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document."""
    base = stored(sketches(docs, shingle), "sketches")
    reps = base.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    reps = stored(reps.where("doc_id is not null"), "reps")
    entries = inverted(reps, percent)
    listed = stored(entries.join(reps.select("doc_id", "n", "sketch"), "doc_id"), "lists")
    # lists and pairs hold ids alone; sketches join what is left of them, once for each pair
    member = listed.select(F.explode("values").alias("value"), "doc_id", "centre")
    pivots = member.groupBy("value").agg(F.max(F.struct("centre", (-F.col("doc_id")).alias("least"), "doc_id")).alias("p"), F.count("*").alias("m")).where("m > 1").select("value", F.col("p.doc_id").alias("b"))
    pairs = member.join(pivots, "value").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    own = listed.select("doc_id", "n", "sketch")
    star = pairs.join(own.withColumnsRenamed({"doc_id": "a", "n": "na", "sketch": "sa"}), "a").join(own.withColumnsRenamed({"doc_id": "b", "n": "nb", "sketch": "sb"}), "b")
    near = stored(_near(star, percent), "near")
    # the full sets are made anew for the documents in the lists alone
    at = listed.select("doc_id")
    if at.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        at = F.broadcast(at)
    sets = stored(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(at, "doc_id", "left_semi"), shingle), "sets")
    links = stored(verified(near, sets, percent), "links")
    first = components(links)
    rest = stored(_tiles(listed, first, sets, percent), "links")
    label = components(links.union(rest)) if not rest.isEmpty() else first
    named = reps.select("set_id", F.col("doc_id").alias("rep")).join(label.withColumnRenamed("doc_id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = base.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for b in batches_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t).tobytes() for t in b.column(1).to_pylist()])], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes binary").dropDuplicates(["doc_id"])


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each component, that of the least doc_id; columns as they were."""
    gone = classes(docs, **how).where("not kept").select(F.col("doc_id").alias("_nd_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_nd_gone"], "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
