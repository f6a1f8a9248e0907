"""Exact Jaccard join of word 5-gram sets by count-vector R-trees.

A document's set is hashed into groups, and the counts by group are a point.
For two sets the summed coordinate minima of their points bound the overlap, and
so do the corner points of R-tree nodes for all documents below them.

Blocks come first: two sets with Jaccard >= t share one of their first
``n - ceil(t n) + 1`` shingles under any order that all documents share. Shingles
that are frequent go last in that order, so blocks stay small; which ones are
frequent only steers the order, never the result. Within each block an R-tree
over the points gives the pairs that the bound leaves, and these are verified on
the full sets. Exact copies are folded to one representative before any of that.

A block of more than ``STAR`` documents (a family of near copies) first pairs all
of them with one pivot, another one in each block. Once components are known,
only pairs across components in such blocks are left to try, which is exact and
needs no quadratic number of rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .textkit import LOWER, NOT_SPACE, U, aliased, find_words, hash_spans, mix, parts, slices, stage, text_column, tidy

SHINGLE = 5
NUM, DEN = 80, 100  # linked if DEN * intersection >= NUM * union
GROUPS, FINE_GROUPS = 32, 256
#: Shingles a group of the finest points, made for sets beyond FINE_GROUPS such groups: counts of large sets in few groups bound nothing.
EACH_GROUP = 4
#: Counts from here on stand for the whole size; sets beyond GROUPS times as many shingles are left to the finer points.
FULL = 255
#: A shingle in so many documents goes to the end of the order, the most frequent last.
FREQUENT = 64
#: So many of them at most (16 bytes each) are sent to the tasks; the rest keep their place in the order.
FREQUENT_MOST = 1 << 18
STAR = 256
LEAF = 16
TILE = 1 << 16
#: A candidate's group is cut into parts of about so many shingles (8 bytes each) and documents, each verified by one task.
GROUP_MOST, GROUP_DOCS = 1_000_000, 2_000
#: Ids up to this number (8 bytes each) are broadcast to fetch texts again; beyond, the texts are shuffled by id.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: pa.Array):
    """For each text the sorted distinct hashes of its word 5-grams; of the whole sequence if it has fewer words."""
    for _, _, buf, offs in slices(texts):
        buf = LOWER[buf]
        starts, ends, by = find_words(buf, offs, NOT_SPACE)
        h = hash_spans(buf, starts, ends)
        acc = np.zeros(max(0, len(h) - SHINGLE + 1), U)
        for k in range(SHINGLE):
            acc = acc * U(0xC2B2AE3D27D4EB4F) + h[k : len(h) - SHINGLE + 1 + k]
        acc = mix(acc)
        for lo, hi in zip(by, by[1:], strict=False):
            if hi - lo >= SHINGLE:
                got = np.sort(acc[lo : hi - SHINGLE + 1])
                keep = np.ones(len(got), bool)
                keep[1:] = got[1:] != got[:-1]
                yield got[keep]
            elif hi > lo:
                one = np.zeros(1, U)
                for x in h[lo:hi]:
                    one = one * U(0xC2B2AE3D27D4EB4F) + x
                yield mix(one + U(hi - lo))
            else:
                yield np.empty(0, U)


def points(sets: np.ndarray, groups: int) -> bytes:
    """Counts by group; FULL stands for that many or more."""
    return np.minimum(np.bincount((sets >> U(40)).astype(np.int64) & (groups - 1), minlength=groups), FULL).astype(np.uint8).tobytes()


def read_points(column: pa.ChunkedArray | pa.Array, n: np.ndarray, groups: int) -> np.ndarray:
    """The counts of rows of sizes ``n``; a full one becomes the whole size, which bounds it."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    got = np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(len(array), groups).astype(np.int32)
    rows, where = np.nonzero(got == FULL)
    got[rows, where] = n[rows]
    return got


def finest_groups(n: int) -> int:
    """A power of two that grows with the set; FINE_GROUPS where these are fine enough."""
    return min(1 << 24, max(FINE_GROUPS, 1 << max(0, -(-n // EACH_GROUP) - 1).bit_length()))


def finest_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """Summed minima of two finest points; the longer one is folded to the groups of the other, which are its low bits."""
    x, y = (np.where((p := np.frombuffer(raw, np.uint8).astype(np.int64)) == FULL, n, p) for raw, n in ((a, n_a), (b, n_b)))
    groups = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, groups).sum(0), y.reshape(-1, groups).sum(0)).sum())


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def need(n_a, n_b):
    """The least overlap of linked sets of these sizes, times (NUM + DEN)."""
    return NUM * (n_a + n_b)


# ---- the order of shingles -------------------------------------------------------------------------------------------


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles seen in many documents, at most FREQUENT_MOST, sorted by hash.

    Tasks count the shingles of every text and pass on those that occur in three
    documents of the same batch, so a shingle in few documents may be missed; it
    then stays in its place in the order.
    """

    def count(batches):
        for batch in batches:
            held, size = [], 0

            def flush(held=held):
                u, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U), np.empty(0, np.int64))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(u[c >= 3].view(np.int64)), pa.array(c[c >= 3], pa.int64())], names=["shingle", "n"])

            for s in shingle_sets(batch.column(0)):
                held.append(s)
                size += len(s)
                if size > 4_000_000:
                    yield flush()
                    size = 0
            yield flush()

    rows = docs.mapInArrow(tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    found = rows.orderBy(F.desc("n"), "shingle").limit(FREQUENT_MOST).toPandas()
    got = found["shingle"].to_numpy(np.int64).view(U)
    order = np.argsort(got)
    return got[order], found["n"].to_numpy(np.int64)[order]


PROFILE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("point", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("finest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def profiles(docs: DataFrame, order) -> DataFrame:
    """PROFILE rows of (doc_id, text) rows: set size, digest of the set, points and the block keys."""

    def run(batches):
        frequent, rank = order.value
        for batch in batches:
            ids = batch.column(0)
            n, d, point, fine, finest, keys, sizes, at = [], [], [], [], [], [], [0], 0
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                d.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                point.append(points(s, GROUPS))
                fine.append(points(s, FINE_GROUPS))
                groups = finest_groups(len(s))
                finest.append(points(s, groups) if groups > FINE_GROUPS else None)
                p = prefix_length(len(s))
                if len(frequent) and len(s):
                    pos = np.searchsorted(frequent, s)
                    pos[pos == len(frequent)] = 0
                    often = frequent[pos] == s
                    first = s[~often]
                    if len(first) < p:
                        first = np.concatenate([first, s[often][np.argsort(rank[pos[often]], kind="stable")]])
                    keys.append(first[:p])
                else:
                    keys.append(s[:p])
                at += p
                sizes.append(at)
                if at > 2_000_000:
                    yield emit(ids.slice(0, len(n)), n, d, point, fine, finest, keys, sizes)
                    ids = ids.slice(len(n))
                    n, d, point, fine, finest, keys, sizes, at = [], [], [], [], [], [], [0], 0
            yield emit(ids, n, d, point, fine, finest, keys, sizes)

    def emit(ids, n, d, point, fine, finest, keys, sizes):
        halves = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(point, pa.binary()), pa.array(fine, pa.binary()), pa.array(finest, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], names=PROFILE.names)

    return docs.mapInArrow(tidy(run), PROFILE)


# ---- blocks and the R-tree ---------------------------------------------------------------------------------------------


def runs_of(batches, key=0, most=1_000_000):
    """Groups of consecutive Arrow batches by an int64 key column: (columns as arrays, first rows of the runs, all ended?).

    Rows must be sorted by the key. A run longer than ``most`` comes in pieces.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table.column(key).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if not cut and len(keys) >= most:
            cut = len(keys)
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def in_blocks(rows: DataFrame) -> DataFrame:
    """Of (key, doc_id) rows those whose key has another row; ``large`` if more than STAR, with a pivot that differs from key to key."""

    def run(batches):
        last_large = None
        for table in runs_of(batches):
            keys, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            each = np.repeat(size, size)
            large = each > STAR
            if last_large is not None:
                large |= keys == last_large
            last_large = keys[-1] if large[-1] and len(size) == 1 else None
            keep = (each > 1) | large
            pivot = np.zeros(len(keys), np.int64)
            for lo, n in zip(first[size > STAR], size[size > STAR], strict=True):
                pivot[lo : lo + n] = ids[lo + np.argmin(mix(ids[lo : lo + n].view(U) * U(2) + mix(keys[lo : lo + 1].view(U))))]
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep]), pa.array(large[keep]), pa.array(pivot[keep])], names=["key", "doc_id", "large", "pivot"])

    sorted_rows = rows.select("key", "doc_id").repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(tidy(run), "key long, doc_id long, large boolean, pivot long")


class CountTree:
    """A packed R-tree over count vectors: leaves of LEAF points, each node with its upper corner and its sizes' range."""

    def __init__(self, n: np.ndarray, point: np.ndarray):
        order = np.argsort(n, kind="stable")
        # Sort-tile: strips by size, then by the widest coordinate within each strip.
        strip = max(LEAF, int(math.sqrt(len(n) / LEAF)) * LEAF)
        widest = int(np.argmax(point.std(0))) if len(n) > LEAF else 0
        self.order = np.concatenate([o[np.argsort(point[o, widest], kind="stable")] for o in np.split(order, range(strip, len(order), strip))])
        self.n, self.point = n[self.order], point[self.order]
        cuts = np.arange(0, len(n), LEAF)
        self.levels = [(cuts, np.maximum.reduceat(self.point, cuts, axis=0), np.minimum.reduceat(self.n, cuts), np.maximum.reduceat(self.n, cuts))]
        while len(self.levels[-1][0]) > LEAF:
            _, top, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), LEAF)
            self.levels.append((cuts, np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, n: int, point: np.ndarray) -> np.ndarray:
        """Rows whose bound allows a link with the given set."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            _, top, low, high = self.levels[depth]
            fits = (DEN * high[nodes] >= NUM * n) & (DEN * n >= NUM * low[nodes])
            nodes = nodes[fits]
            bound = np.minimum(top[nodes], point).sum(1)
            nodes = nodes[(NUM + DEN) * bound >= need(n, np.maximum(low[nodes], -(-NUM * n // DEN)))]
            below = len(self.levels[depth - 1][0]) if depth else len(self.n)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        sizes = self.n[nodes]
        bound = np.minimum(self.point[nodes], point).sum(1)
        return self.order[nodes[(DEN * np.minimum(sizes, n) >= NUM * np.maximum(sizes, n)) & ((NUM + DEN) * bound >= need(n, sizes))]]


def block_pairs(rows: DataFrame, groups: int, across: bool = False) -> DataFrame:
    """Distinct pairs (a < b) of rows of a block that the bound leaves.

    ``rows``: key, doc_id, n, point, and pivot, large (a large block's rows pair
    with their pivot only) or, with ``across``, component (only pairs of different
    components, in blocks of any size); ``groups`` is the number of the points' coordinates.
    """

    def run(batches):
        for table in runs_of(batches):
            keys, ids, n = (table.column(i).to_numpy() for i in range(3))
            point = read_points(table.column(3), n, groups)
            mark = table.column(4).to_numpy(zero_copy_only=False)
            large = np.zeros(len(keys), bool) if across else table.column(5).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            last = np.r_[first[1:], len(keys)]
            out_a, out_b = [], []

            def keep(i, j, n=n, point=point, ids=ids, out_a=out_a, out_b=out_b):
                ok = (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
                i, j = i[ok], j[ok]
                ok = (NUM + DEN) * np.minimum(point[i], point[j]).sum(1) >= need(n[i], n[j])
                out_a.append(ids[i[ok]])
                out_b.append(ids[j[ok]])

            two = first[last - first == 2]
            if len(two) and not across:
                keep(two, two + 1)
            for lo, hi in zip(first, last, strict=True):
                if across:
                    part = np.unique(mark[lo:hi], return_inverse=True)[1]
                    if not part.any():
                        continue
                    tree = CountTree(n[lo:hi], point[lo:hi])
                    for i in np.flatnonzero(part != np.argmax(np.bincount(part))):
                        j = tree.search(n[lo + i], point[lo + i])
                        j = j[part[j] != part[i]]
                        out_a.append(np.full(len(j), ids[lo + i]))
                        out_b.append(ids[lo + j])
                elif large[lo]:
                    at = np.flatnonzero(ids[lo:hi] == mark[lo])
                    if len(at):
                        keep(np.full(hi - lo, lo + at[0]), np.arange(lo, hi))
                elif hi - lo > 4 * LEAF:
                    tree = CountTree(n[lo:hi], point[lo:hi])
                    for i in range(hi - lo):
                        j = tree.search(n[lo + i], point[lo + i])
                        j = j[j > i]
                        out_a.append(np.full(len(j), ids[lo + i]))
                        out_b.append(ids[lo + j])
                elif hi - lo > 2:
                    i, j = np.triu_indices(hi - lo, 1)
                    keep(lo + i, lo + j)
            a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    marks = ["component"] if across else ["pivot", "large"]
    sorted_rows = rows.select("key", "doc_id", "n", "point", *marks).repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def tiles(rows: DataFrame) -> DataFrame:
    """Blocks beyond TILE rows cut into pairs of tiles, so that no task holds more than two tiles of a block."""
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t"))
    tile = F.pmod(F.xxhash64("doc_id"), "t").cast("int")
    cut = rows.join(size, "key").withColumn("i", tile).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    return cut.withColumn("key", F.when(F.col("t") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))).drop("t", "i", "j")


# ---- verification -----------------------------------------------------------------------------------------------------


def verified(pairs: DataFrame, profile: DataFrame, docs: DataFrame) -> DataFrame:
    """Linked pairs (a, b) that span all components of links among ``pairs``; first the bounds by finer groups, then the sets themselves."""
    pairs = stage(pairs, "pairs")
    fine = only(profile.select("doc_id", F.col("n").alias("n_"), F.col("fine").alias("f_")), pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")))

    def close(batches):
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            f_a, f_b = read_points(batch.column(3), n_a, FINE_GROUPS), read_points(batch.column(5), n_b, FINE_GROUPS)
            ok = (NUM + DEN) * np.minimum(f_a, f_b).sum(1) >= need(n_a, n_b) if len(n_a) else np.empty(0, bool)
            long = np.array([finest_groups(n) > FINE_GROUPS for n in np.minimum(n_a, n_b).tolist()], bool)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (batch.column(0), batch.column(1), pa.array(long))], names=["a", "b", "long"])

    def closer(batches):
        for batch in batches:
            a, b, n_a, f_a, n_b, f_b = (c.to_pylist() for c in batch.columns)
            ok = pa.array([(NUM + DEN) * finest_bound(f_a[i], f_b[i], n_a[i], n_b[i]) >= need(n_a[i], n_b[i]) for i in range(len(a))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])

    both = pairs.join(fine.toDF("a", "n_a", "f_a"), "a").join(fine.toDF("b", "n_b", "f_b"), "b")
    near = stage(both.select("a", "b", "n_a", "f_a", "n_b", "f_b").mapInArrow(tidy(close), "a long, b long, long boolean"), "near")
    long = near.where("long").select("a", "b")
    if not long.isEmpty():
        finest = only(profile.where("finest is not null").select("doc_id", F.col("n").alias("n_"), F.col("finest").alias("f_")), long.select(F.col("a").alias("doc_id")).unionAll(long.select("b")))
        both = long.join(finest.toDF("a", "n_a", "f_a"), "a").join(finest.toDF("b", "n_b", "f_b"), "b")
        long = both.select("a", "b", "n_a", "f_a", "n_b", "f_b").mapInArrow(tidy(closer), "a long, b long")
        near = stage(near.where("not long").select("a", "b").unionAll(long), "near")
    near = near.select("a", "b")
    # First each set with its smallest partner. A partner and its sets are a group, cut into parts that each hold the partner, so a set travels once or twice in all.
    star = near.groupBy("b").agg(F.min("a").alias("a"))
    size = star.join(profile.select(F.col("doc_id").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(F.greatest(F.sum("n") / GROUP_MOST, F.count("*") / GROUP_DOCS)).cast("int").alias("parts"))
    star = stage(star.join(size, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), "parts")).alias("g")), "stars")
    places = star.select(F.col("b").alias("doc_id"), "g").unionAll(star.select("a", "g").distinct())
    places = F.broadcast(places) if star.count() <= BROADCAST_IDS // 4 else places
    first = stage(_linked_in_groups(star, docs.join(places, "doc_id").select("doc_id", "text", "g").mapInArrow(tidy(_sets), "doc_id long, shingles binary, g long")), "links")
    # Then, pair by pair, what is still apart.
    at = connected_components(first)
    apart = near.join(at.toDF("a", "x"), "a", "left").join(at.toDF("b", "y"), "b", "left").where("coalesce(x, a) <> coalesce(y, b)").select("a", "b")
    apart = stage(apart.join(star.select("a", "b"), ["a", "b"], "left_anti"), "apart")
    if apart.isEmpty():
        return first
    needed = only(docs, apart.select(F.col("a").alias("doc_id")).unionAll(apart.select("b"))).withColumn("g", F.lit(0).cast("long"))
    return first.unionAll(_linked_pairs(apart, needed.select("doc_id", "text", "g").mapInArrow(tidy(_sets), "doc_id long, shingles binary, g long").select("doc_id", "shingles")))


def _sets(batches):
    """(doc_id, shingles, g) of (doc_id, text, g) rows."""
    for batch in batches:
        for part in parts(batch):
            held = pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), held, part.column(2)], names=["doc_id", "shingles", "g"])


def linked_sets(s: np.ndarray, t: np.ndarray) -> bool:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and DEN * common >= NUM * (len(s) + len(t) - common)


def _linked_in_groups(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Links that span the components within groups; a group's sets travel once, and its pairs (a, b, g) are tried until they join nothing new."""

    def run(batches):
        now, sets, parent = None, {}, {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # A group's sets and links so far stay until the next group begins, in whichever batches its rows come.
        for batch in batches:
            key, a, b = (batch.column(i).to_pylist() for i in range(3))
            held, out = batch.column(3), []
            for i, k in enumerate(key):
                if k != now:
                    now = k
                    sets.clear()
                    parent.clear()
                if b[i] is None:
                    sets.setdefault(a[i], []).append(np.frombuffer(held[i].as_py(), U))
                else:
                    x, y = root(a[i]), root(b[i])
                    if x != y and any(linked_sets(s, t) for s in sets[a[i]] for t in sets[b[i]]):
                        parent[x] = y
                        out.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    none = F.lit(None)
    rows = full.select("g", F.col("doc_id").alias("a"), none.cast("long").alias("b"), "shingles").unionAll(pairs.select("g", "a", "b", none.cast("binary")))
    return rows.repartition("g").sortWithinPartitions("g", F.col("b").asc_nulls_first()).mapInArrow(tidy(run), "a long, b long")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without those that ``ids`` (doc_id) can't need, if so few ids that they can be broadcast; else all."""
    return rows.join(F.broadcast(ids.distinct()), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else rows


def _linked_pairs(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The sets travel with each pair."""

    def run(batches):
        for batch in batches:
            ok = [linked_sets(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    joined = pairs.join(full.toDF("a", "s_a"), "a").join(full.toDF("b", "s_b"), "b").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(tidy(run), "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Texts are lower-cased in A-Z and cut at blanks and 0x09-0x0D; a set holds the
    distinct 5-word shingles, or the whole sequence where there are fewer words.
    Two documents link when 100 * intersection >= 80 * union; component_id is the
    smallest doc_id reached, the own one included. Null, empty and blank texts
    have an empty set and link with nothing. Rows that repeat a doc_id are one
    node; rows with a null doc_id link with nothing and have a null component.
    Texts of any length are taken whole; of equal texts the smallest doc_id stands
    for all. Other columns don't matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(frequent_shingles(rows.select("text")))
    profile = stage(profiles(rows, order), "profile")
    sets = profile.where("doc_id is not null and n_shingles > 0").withColumnRenamed("n_shingles", "n")
    first = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    copies = stage(sets.select("doc_id", "d1", "d2").join(first, ["d1", "d2"]).where("doc_id <> rep").select("doc_id", "d1", "d2").distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS // 3 else copies
    reps = sets.join(copies, ["doc_id", "d1", "d2"], "left_anti")
    blocks = stage(in_blocks(reps.select("doc_id", F.explode("keys").alias("key"))), "blocks")
    coarse, fine = reps.select("doc_id", "n", "point"), reps.select("doc_id", "n", F.col("fine").alias("point"))
    large = blocks.where("large")
    any_large = not large.isEmpty()
    fine = only(fine, large.select("doc_id")) if any_large else fine
    pairs = block_pairs(blocks.where("not large").join(coarse, "doc_id"), GROUPS)
    if any_large:
        pairs = pairs.unionAll(block_pairs(large.join(fine, "doc_id"), FINE_GROUPS)).distinct()
    edges = stage(verified(pairs, reps, rows), "links")
    labels = connected_components(edges)
    if any_large:
        labels = stage(labels, "labels")
        at = large.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        split = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        left = tiles(at.join(split, "key", "left_semi")).join(fine, "doc_id")
        more = stage(verified(block_pairs(left, FINE_GROUPS, across=True), reps, rows), "links")
        if not more.isEmpty():
            labels = connected_components(edges.unionAll(more))
    members = first.withColumnRenamed("rep", "doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("d1", "d2", F.coalesce("component", "doc_id").alias("component"))
    return (
        profile.select("doc_id", "n_shingles", "d1", "d2")
        .join(members, ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, columns unchanged whatever their names, with one document of each component left: that of the smallest doc_id.

    Rows that repeat a doc_id are one document, which stays or goes whole; rows
    with a null doc_id stay, and so do null and empty texts; an empty table gives an empty one.
    """
    found = stage(jaccard_components(docs, doc_id, text), "components")
    rows, names = aliased(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(names[doc_id])).distinct()
    gone = F.broadcast(gone) if found.where("doc_id <> component_id").count() <= BROADCAST_IDS else gone
    return rows.join(gone, names[doc_id], "left_anti").select(*rows.columns).toDF(*docs.columns)
