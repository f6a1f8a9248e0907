"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the axis it lies closest to, with the sign. A table joins
``HASHES`` such hashes to a bucket within the vector's label, and besides the
own bucket a vector enters those where the runner-up axis of one hash stands in
(multiprobe). Pairs that share a bucket are verified by cosine in double
precision. Exact copies, told by a digest of 128 bits, are folded to one weighted
representative first, so vectors travel with their candidates only. Ids that
come with several vectors can't be counted by weights: the links of vectors that
they own are told one by one, and count each id once.

Buckets beyond ``TILE`` vectors are cut into pairs of tiles. A pair of vectors is
counted in the first of their common buckets only, so sums of counts and a
spanning forest per tile pair leave a task, and never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .textkit import U, mix, stage, tidy

COSINE = 0.98
TABLES, HASHES, PROBES = 6, 3, 2
TILE = 1024
SEED = 11


def rotations(dim: int) -> np.ndarray:
    """Signs (tables x hashes x 3 x width), the same for each task; width is the power of two that holds dim."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (TABLES, HASHES, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised fast transform along the last axis."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], -2).reshape(x.shape)
        h *= 2
    return x


def buckets(vectors: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(n x TABLES * (1 + PROBES)) bucket numbers of unit vectors, each row sorted."""
    n, dim = vectors.shape
    signs = rotations(dim)
    width = signs.shape[-1]
    x = np.zeros((n, width))
    x[:, :dim] = vectors
    out = []
    seed = mix(label.astype(np.int64).view(U) + U(0x51ED270B))
    for t in range(TABLES):
        best, second, loss = [], [], []
        for k in range(HASHES):
            y = x
            for s in signs[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(size, -3, axis=1)[:, -3:] if width > 2 else np.argsort(size, axis=1)
            order = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), 1), 1)
            code = order * 2 + (np.take_along_axis(y, order, 1) < 0)
            norm = np.take_along_axis(size, order, 1) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
            best.append(code[:, 0])
            for r in range(1, code.shape[1]):
                second.append((k, code[:, r]))
                loss.append(norm[:, 0] - norm[:, r])
        codes = [np.stack(best, 1)]
        pick = np.argsort(np.stack(loss, 1), 1)[:, :PROBES]
        for r in range(pick.shape[1]):
            probe = codes[0].copy()
            for j, (k, code) in enumerate(second):
                rows = pick[:, r] == j
                probe[rows, k] = code[rows]
            codes.append(probe)
        for c in codes:
            h = mix(seed + U(t + 1))
            for k in range(HASHES):
                h = mix(h + c[:, k].astype(U) + U(1))
            out.append(h.view(np.int64))
    return np.sort(np.stack(out, 1), 1)


def _unit(column: pa.Array) -> np.ndarray:
    values = np.array(column.to_pylist(), np.float64)
    values = values.reshape(len(column), -1)
    largest = np.abs(values).max(1, keepdims=True)
    values = values / largest
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _hashed(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            at = np.zeros((batch.num_rows, TABLES * (1 + PROBES)), np.int64)
            dims = np.array([len(v) for v in batch.column(4)])
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                at[where] = buckets(_unit(batch.column(4).take(pa.array(where))), batch.column(1).to_numpy()[where] * 1_000_003 + dim)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), at.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["rep", "label", "h1", "h2", "vector", "first", "copies", "several", "buckets"])

    return rows.mapInArrow(tidy(run), "rep long, label long, h1 long, h2 long, vector array<double>, first long, copies long, several boolean, buckets array<long>")


def _tile_pairs(rows: DataFrame) -> DataFrame:
    """(bucket, i, j, tile and the row) of buckets with two rows or more."""
    each = rows.select("rep", F.explode(F.array_distinct("buckets")).alias("bucket"))
    size = each.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket", F.ceil(F.col("c") / TILE).cast("int").alias("t"))
    placed = each.join(size, "bucket").withColumn("tile", F.pmod(F.xxhash64("rep"), "t").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    placed = placed.select("rep", "bucket", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    return placed.join(rows.select("rep", "copies", "several", "vector", "buckets"), "rep")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        now = root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


LINKS = "rep long, links long, a long, b long, x long, y long"


def _links(pairs: DataFrame) -> DataFrame:
    """LINKS of three kinds: (rep, links) partial numbers of linked ids, (a, b) edges that span the links of a tile pair, (x, y) links with a vector of ids that have several."""

    def links(table: pa.Table, bucket: int) -> tuple[np.ndarray, ...]:
        rep, copies, several = table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("several").to_numpy()
        tile = table.column("tile").to_numpy()
        vectors = _unit(table.column("vector").combine_chunks())
        own = np.array(table.column("buckets").to_pylist(), np.int64).reshape(len(rep), -1)
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= COSINE)
        a, b = left[a], right[b]
        ok = rep[a] < rep[b] if low == high else rep[a] != rep[b]
        a, b = a[ok], b[ok]
        root = _roots(a, b, len(rep))
        joined = np.flatnonzero(root != np.arange(len(rep)))
        first = np.ones(len(a), bool)
        for k in range(own.shape[1]):  # a pair counts in the first bucket that both are in
            rows = np.flatnonzero(first & (own[a, k] < bucket))
            for s in range(0, len(rows), 65536):
                r = rows[s : s + 65536]
                first[r] &= ~(own[a[r], k][:, None] == own[b[r]]).any(1)
        a, b = a[first], b[first]
        count = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        seen = np.flatnonzero(count)
        told = several[a] | several[b]
        return rep[seen], count[seen].astype(np.int64), rep[joined], rep[root[joined]], rep[a[told]], rep[b[told]]

    def run(batches):
        held = None
        for batch in [*_batches_then_none(batches)]:
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            ends = np.r_[first[1:], len(key)]
            whole = len(first) if batch is None else len(first) - 1
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for lo, hi in zip(first[:whole], ends[:whole], strict=True):
                if hi - lo > 1:
                    for held_, new in zip(out, links(table.slice(lo, hi - lo), int(key[lo, 0])), strict=True):
                        held_.append(new)
            held = table.slice(first[whole]) if whole < len(first) else None
            columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            sizes = [len(columns[k]) for k in (0, 2, 4)]
            spread = []
            for k, column in enumerate(columns):
                full, there = np.zeros(sum(sizes), np.int64), np.zeros(sum(sizes), bool)
                lo = sum(sizes[: k // 2])
                full[lo : lo + len(column)], there[lo : lo + len(column)] = column, True
                spread.append(pa.array(full, mask=~there))
            yield pa.RecordBatch.from_arrays(spread, names=[c.split()[0] for c in LINKS.split(", ")])

    placed = pairs.select("bucket", "i", "j", "tile", "rep", "copies", "several", "vector", "buckets").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return placed.mapInArrow(tidy(run), LINKS)


def _batches_then_none(batches):
    yield from batches
    yield None


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label, which isn't null, link at a cosine of at least COSINE
    in double precision; every pair reported is verified, and the recall is what
    the tables and probes give. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing, and so do those of different
    lengths. Exact copies link with each other. Rows that repeat a vec_id are one
    node, whose links are those of all its vectors, each other id counted once
    and itself never; a null vec_id links with nothing and has null component_id
    and kept false. Other columns don't matter; an empty table gives an empty one.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(fits).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    same = ["label", "h1", "h2"]
    good = good.withColumn("h1", F.xxhash64(F.lit(1), "vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    repeated = stage(rows.where("vec_id is not null").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    several = None
    if repeated.isEmpty():
        known = good.withColumn("several", F.lit(False))
    else:
        distinct = good.dropDuplicates(["vec_id", *same])
        several = stage(distinct.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("several")), "several")
        known = distinct.join(several, "vec_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    reps = known.groupBy(*same).agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first"), F.count_if(~F.col("several")).alias("copies"), F.max("several").alias("several"))
    reps = stage(_hashed(reps.select(F.monotonically_increasing_id().alias("rep"), *same, "vector", "first", "copies", "several")), "vectors")
    found = stage(_links(_tile_pairs(reps)), "vector-links")
    names = reps.select("rep", "first")
    edges = found.where("a is not null").join(names.toDF("a", "u"), "a").join(names.toDF("b", "v"), "b").select("u", "v")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    # What a vector of one id links with: the ids of one vector by weight, and its own copies.
    told = reps.select(*same, "rep", "first", "copies").join(counts, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies"))
    extra = None
    if several is not None and not several.isEmpty():
        owned = known.where("several").join(reps.where("several").select(*same, "rep", "first"), same)
        owned = stage(owned.select("rep", "first", F.col("vec_id").alias("owner")), "owned")
        edges = edges.unionAll(owned.select("first", "owner"))
        pairs = found.where("x is not null").select("x", "y")
        pairs = pairs.unionAll(pairs.select("y", "x")).unionAll(owned.select("rep", "rep")).distinct()
        near = pairs.join(owned.select(F.col("rep").alias("y"), "owner"), "y").select("x", "owner").distinct()
        told = told.join(near.groupBy(F.col("x").alias("rep")).agg(F.count("*").alias("others")), "rep", "left").withColumn("links", F.col("links") + F.coalesce("others", F.lit(0))).drop("others")
        mine = owned.select(F.col("rep").alias("x"), F.col("owner").alias("vec_id")).join(pairs, "x").select("vec_id", "y").distinct()
        weights = mine.join(reps.select(F.col("rep").alias("y"), "copies"), "y").groupBy("vec_id").agg(F.sum("copies").alias("n"))
        others = mine.join(owned.select(F.col("rep").alias("y"), "owner"), "y").select("vec_id", "owner").distinct().groupBy("vec_id").agg((F.count("*") - 1).alias("m"))
        extra = weights.join(others, "vec_id").select("vec_id", (F.col("n") + F.col("m")).alias("all"))
    labels = connected_components(edges, "u", "v")
    told = told.join(labels.withColumnRenamed("id", "first"), "first", "left")
    told = told.select(*same, (F.col("links") - 1).alias("n"), F.coalesce("component", "first").alias("c"))
    joined = good.join(told, same).select("vec_id", "n", "c")
    alone = rows.where(~fits).select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("c"))
    out = joined.unionAll(alone)
    if not repeated.isEmpty():
        # Rows of one id are one node, those that link with nothing too.
        node = out.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.max("n").alias("n_"), F.min("c").alias("c_"))
        out = out.join(node, "vec_id", "left").select("vec_id", F.coalesce("n_", "n").alias("n"), F.coalesce("c_", "c").alias("c"))
    if extra is not None:
        out = out.join(extra, "vec_id", "left").select("vec_id", F.coalesce("all", "n").alias("n"), "c")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", "vec_id").alias("c"))
    return out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(False)).alias("kept"))
