r"""Hard negatives by product quantisation with residual norms.

Vectors are cut into pieces, and each piece stands for the nearest of some
centroids, fitted on a bounded sample; every row is indexed by its piece numbers and,
for each piece, the length of what the centroid leaves over. For an anchor, a table
of its products with all centroids gives a row's score by look-ups, and the lengths
of the anchor's pieces times those left over bound by how much that can be off. Rows
whose bounds lie outside a window, or below the scores already found, are out for
certain; the others' integer scores are computed.

Anchors are dealt into blocks and rows into a fixed number of slices; a task streams a
slice past a block, with the best of each anchor so far. So what leaves it grows
with the anchors alone, whatever group, label or copy is common.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import small_batches, stage, tidy

#: Rows that the centroids are fitted on, at most; everything else covers all rows.
SAMPLE = 4096
PIECES, CENTROIDS, ROUNDS = 8, 64, 6
#: Anchors of a block (some 100 KB a thousand), slices of rows, and rows and anchors scored at a time.
BLOCK, SLICES, ROWS, ANCHORS = 16_384, 16, 2048, 256
#: Components beyond this are taken as this, so that products of a thousand of them stay whole numbers of 64 bits.
MOST = 1 << 26
SEED = 5


class Quantiser:
    """Centroids of each piece (pieces x centroids x width)."""

    def __init__(self, sample: np.ndarray, pieces: int = PIECES, centroids: int = CENTROIDS):
        rng = np.random.default_rng(SEED)
        self.dim = sample.shape[1]
        self.pieces = max(1, min(pieces, self.dim))
        self.width = -(-self.dim // self.pieces)
        cut = self._cut(sample.astype(np.float64))
        self.centroids = np.zeros((self.pieces, centroids, self.width))
        for m in range(self.pieces):
            x = cut[:, m]
            if len(x):
                now = x[rng.choice(len(x), centroids, replace=len(x) < centroids)]
                for _ in range(ROUNDS):
                    near = self._nearest(x, now)
                    count = np.bincount(near, minlength=centroids)
                    sums = np.stack([np.bincount(near, x[:, k], centroids) for k in range(self.width)], 1)
                    now = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], now)
                self.centroids[m] = now

    @staticmethod
    def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)

    def _cut(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.pieces * self.width))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), self.pieces, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers and the lengths of what is left over (both rows x pieces)."""
        cut = self._cut(x.astype(np.float64))
        codes = np.stack([self._nearest(cut[:, m], self.centroids[m]) for m in range(self.pieces)], 1) if len(x) else np.zeros((0, self.pieces), np.int64)
        left = np.stack([cut[:, m] - self.centroids[m][codes[:, m]] for m in range(self.pieces)], 1)
        return codes.astype(np.uint8), np.sqrt((left**2).sum(2))

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with all centroids (anchors x pieces x centroids), and lengths of pieces."""
        cut = self._cut(anchors.astype(np.float64))
        return np.einsum("amw,mcw->amc", cut, self.centroids), np.sqrt((cut**2).sum(2))

    def bounds(self, tables: np.ndarray, lengths: np.ndarray, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), anchors x rows, that the scores lie between for certain."""
        score = np.zeros((len(tables), len(codes)))
        for m in range(self.pieces):
            score += tables[:, m][:, codes[:, m]]
        sizes = np.sqrt((self.centroids**2).sum(2))[np.arange(self.pieces), codes] + left
        off = lengths @ (left + 1e-10 * sizes).T + 0.5  # rounding; scores are whole numbers
        return score - off, score + off


def _best(held: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first by falling score and rising id of those held and the new ones."""
    score, ids = np.r_[held[0], score], np.r_[held[1], ids]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def whole_numbers(column: Column, scale: int) -> Column:
    """floor(scale * x) of each component, at most MOST either way."""
    return F.transform(column, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-MOST)), F.lit(MOST)).cast("int"))


EACH = "id long, label long, vector array<int>, codes binary, left binary"
NAMES = [c.split()[0] for c in EACH.split(", ")]
FOUND = "anchor long, positive long, positive_score long, id long, score long"


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones ending in zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    n = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _index(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """EACH of ``rows`` (id, label, vector, anchor), and anchor: all rows with their piece numbers and what is left over."""

    def run(batches):
        for batch in batches:
            codes, left = quantiser.encode(_matrix(batch.column(2), quantiser.dim))
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (codes, left)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *packed, batch.column(3)], names=[*NAMES, "anchor"])

    return rows.select("id", "label", "vector", "anchor").mapInArrow(tidy(run), EACH + ", anchor boolean")


class _Rows:
    """Some rows of the table in numpy."""

    def __init__(self, batch: pa.RecordBatch, quantiser: Quantiser):
        self.id, self.label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        self.x = _matrix(batch.column("vector"), quantiser.dim)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, quantiser.pieces)
        self.left = np.frombuffer(b"".join(batch.column("left").to_pylist()), np.float64).reshape(-1, quantiser.pieces)


class _Anchors(_Rows):
    """The anchors of a block, and the best rows that each has met: a list by positive for windows, or one list of positives."""

    def __init__(self, batch: pa.RecordBatch, quantiser: Quantiser, many: int, share: tuple[int, int] | None):
        super().__init__(batch, quantiser)
        self.many, self.share, self.quantiser = many, share, quantiser
        self.positives = batch.column("positives").to_pylist()
        self.scores = batch.column("scores").to_pylist()
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.held = [[none] * (1 if share is None else len(s)) for s in self.scores]

    def meet(self, rows: _Rows) -> None:
        for lo in range(0, len(self.id), ANCHORS):
            some = slice(lo, lo + ANCHORS)
            tables, lengths = self.quantiser.tables(self.x[some])
            low, high = self.quantiser.bounds(tables, lengths, rows.codes, rows.left)
            for i in range(lo, min(lo + ANCHORS, len(self.id))):
                if self.held[i]:
                    (self._positives if self.share is None else self._windows)(i, low[i - lo], high[i - lo], rows)

    def _positives(self, i: int, low: np.ndarray, high: np.ndarray, rows: _Rows) -> None:
        at = np.flatnonzero((rows.label == self.label[i]) & (rows.id != self.id[i]))
        held = self.held[i][0]
        if len(held[0]) == self.many:
            at = at[high[at] >= held[0][-1]]
        if len(at) > self.many:
            at = at[high[at] >= np.partition(low[at], len(at) - self.many)[len(at) - self.many]]
        self.held[i][0] = _best(held, rows.x[at] @ self.x[i], rows.id[at], self.many)

    def _windows(self, i: int, low: np.ndarray, high: np.ndarray, rows: _Rows) -> None:
        other = rows.label != self.label[i]
        for k, score in enumerate(self.scores[i]):
            if score < 0:
                continue
            held = self.held[i][k]
            least, most = self.share[0] * score / 100, self.share[1] * score / 100
            least = max(least, held[0][-1]) if len(held[0]) == self.many else least
            at = np.flatnonzero(other & (high >= least) & (low <= most))
            sure = at[high[at] <= most]  # these lie below the window's top for certain
            if len(sure) > self.many:
                at = at[high[at] >= np.partition(low[sure], len(sure) - self.many)[len(sure) - self.many]]
            exact = rows.x[at] @ self.x[i]
            ok = (100 * exact >= self.share[0] * score) & (100 * exact <= self.share[1] * score)
            self.held[i][k] = _best(held, exact[ok], rows.id[at][ok], self.many)

    def found(self) -> pa.RecordBatch:
        out = []
        for i, lists in enumerate(self.held):
            for k, (score, ids) in enumerate(lists):
                asked = (None, None) if self.share is None else (self.positives[i][k], self.scores[i][k])
                out += [(int(self.id[i]), *asked, int(r), int(s)) for s, r in zip(score, ids, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(5)], names=[c.split()[0] for c in FOUND.split(", ")])


def _search(indexed: DataFrame, anchors: DataFrame, blocks: int, quantiser: Quantiser, many: int, share: tuple[int, int] | None) -> DataFrame:
    """FOUND: for each anchor (EACH, positives, scores) the ``many`` best rows of each slice: of its label, or, with a ``share``, of other labels in the window of each positive.

    Anchors of a block come first in its tasks and are held; the rows follow and are not.
    """
    none = F.array().cast("array<long>")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = anchors.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), F.lit(False).alias("row"), *NAMES, "positives", "scores")
    rows = indexed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int").alias("slice"), F.lit(True).alias("row"), *NAMES, none.alias("positives"), none.alias("scores"))

    @tidy
    def run(batches):
        now, waiting, held = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True):
                block_, slice_, row = key[lo]
                if now != (block_, slice_):
                    if held is not None:
                        yield held.found()
                    now, waiting, held = (block_, slice_), [], None
                if not row:
                    waiting.append(batch.slice(lo, hi - lo))
                    continue
                if waiting:
                    held = _Anchors(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], quantiser, many, share)
                    waiting = []
                if held is not None:
                    for start in range(lo, hi, ROWS):
                        held.meet(_Rows(batch.slice(start, min(ROWS, hi - start)), quantiser))
        if held is not None:
            yield held.found()

    dealt = asked.unionAll(rows).repartition("block", "slice").sortWithinPartitions("block", "slice", "row")
    return dealt.mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], many: int) -> DataFrame:
    """The ``many`` first rows of each key by falling score and rising id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= many)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of the rows that ``is_anchor`` holds for.

    Components become floor(scale * x), at most MOST either way; scores are integer
    inner products. The ``positives`` first other rows of an anchor's label, by falling
    score and rising id, are its positives; for each of them the ``negatives`` first rows
    of other labels whose score lies between the shares (per cent) of the positive's
    are returned. Rows with a null id or label, or with a null vector or a null or
    non-finite component, take no part; empty vectors score 0, and shorter ones count
    as ending in zeros. Of rows that repeat an id the one of the smallest label, then
    vector, counts. An anchor without positives, or a positive without a row in its
    window, has no rows; an empty table gives an empty one; other columns don't matter.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vector", finite), F.lit(False)))
    rows = rows.select("id", F.struct("label", whole_numbers(F.col("vector"), scale).alias("vector"), "anchor").alias("r"))
    rows = stage(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.vector", "r.anchor"), "whole-vectors")
    dim, asked = rows.agg(F.max(F.size("vector")), F.count_if("anchor")).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    sample = sample if isinstance(sample, pa.Array) else pa.concat_arrays(sample.chunks)
    quantiser = Quantiser(_matrix(sample, max(1, dim or 0)))
    blocks = max(1, -(-asked // BLOCK))
    indexed = stage(_index(rows, quantiser), "pieces")
    anchors = indexed.where("anchor")
    none = F.array().cast("array<long>")
    near = _search(indexed, anchors.select(*NAMES, none.alias("positives"), none.alias("scores")), blocks, quantiser, positives, None)
    near = _first(near.select("anchor", "id", "score"), ["anchor"], positives).groupBy("anchor").agg(F.collect_list("id").alias("positives"), F.collect_list("score").alias("scores"))
    near = stage(near, "positives")
    told = anchors.select(*NAMES).join(near.withColumnRenamed("anchor", "id"), "id")
    hard = _search(indexed, told, blocks, quantiser, negatives, share)
    hard = _first(hard, ["anchor", "positive"], negatives)
    return hard.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
