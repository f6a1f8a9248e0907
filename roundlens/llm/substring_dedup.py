r"""Repeated passages by recompression.

A document's words are rewritten in rounds. In each, a maximal run of one symbol
becomes a symbol of its own, and then each neighbouring pair whose left symbol
falls into the left half of the alphabet and whose right one into the right half
becomes one symbol. Names are hashes of what they stand for, and halves are bits of
the names, so every task gives the same name to the same thing without a
dictionary, and equal substrings are rewritten alike but for symbols near their
ends. How far beside a symbol the text was looked at is kept with it.

Four passes read the documents, which are dealt once into a bucketed table:

1. Two neighbouring symbols of ``HIGH`` rounds, some hundred words, whose names
   and digests stood earlier are a long repeat: all of it goes.
2. Each other window of ``WINDOW`` words has one interior symbol of few rounds,
   determined by its words alone; the digest of all words that this symbol
   depends on is the window's anchor. Anchors that occur once settle their windows.
3. Windows of anchors that occur twice are verified by digests of 128 bits.
4. Words in removed windows are dropped.

Whatever a part of some megabytes can settle by itself, it does: later copies
within it, and anchors that recur there. So no name sends more than one row per
part to the task that compares it, however common it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .textkit import NOT_SPACE, U, aliased, find_words, hash_spans, mix, parts, scratch, slices, small_batches, stage, staged, text_column, tidy

WINDOW = 20
#: Rounds behind the symbols of long repeats, and at most those behind anchors: pieces of some sixty and of two words.
HIGH, LOW = 14, 2
#: Bytes of an Arrow batch; each pass holds one of texts and one of what it found.
BATCH = 4 << 20

A, B, C, D = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_power, _inverse = np.ones(1, U), np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        up, down = np.full(2 * n, int(B), U), np.full(2 * n, pow(int(B), -1, 1 << 64), U)
        up[0] = down[0] = 1
        _power, _inverse = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _power, _inverse


class Digests:
    """Digests of spans of words by prefix sums; two seeds give two that are independent."""

    def __init__(self, words: np.ndarray, seed: int):
        up, self.down = _powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words + U(seed) * C) * up[: len(words)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U) * A)


class Symbols:
    """The symbols of several documents after some rounds: names, ends of the words they stand for, and the words [left, right) that they depend on.

    A symbol that depends on where its document begins or ends has a left or right beyond it.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, offsets: np.ndarray):
        at = np.arange(len(words))
        self.name, self.doc, self.start, self.end, self.left, self.right, self.offsets = words, doc, at, at + 1, at, at + 1, offsets

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol: how far its left neighbour's and its right neighbour's dependence goes, and whether the right one is of the same document."""
        same = self.doc[1:] == self.doc[:-1]
        left, right = self.offsets[self.doc] - 1, self.offsets[self.doc + 1] + 1
        left[1:][same], right[:-1][same] = self.left[:-1][same], self.right[1:][same]
        return left, right, same

    def _join(self, first: np.ndarray, last: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.name, self.doc, self.start, self.end = name, self.doc[first], self.start[first], self.end[last]
        self.left, self.right = left, right

    def compress(self, level: int) -> None:
        """One round: runs, then pairs."""
        if not len(self.name):
            return
        left, right, same = self._beside()
        first = np.flatnonzero(np.r_[True, ~(same & (self.name[1:] == self.name[:-1]))])
        last = np.r_[first[1:], len(self.name)] - 1
        n = (last - first + 1).astype(U)
        self._join(first, last, np.where(n > U(1), mix(self.name[first] * C + n * A + U(level)), self.name[first]), left[first], right[last])
        left, right, same = self._beside()
        lefts = (mix(self.name ^ U(level * int(D) % (1 << 64))) & U(1)) == 0
        pair = np.zeros(len(self.name), bool)
        pair[:-1] = same & lefts[:-1] & ~lefts[1:]
        second = np.r_[False, pair[:-1]]
        # A symbol that stays alone was looked at with the neighbour that it might have paired with.
        self_left, self_right = np.where(lefts | second, self.left, left), np.where(lefts & ~pair, right, self.right)
        first = np.flatnonzero(~second)
        last = first + pair[first]
        name = np.where(pair[first], mix(self.name[first] * A + mix(self.name[last] + B) * C + U(level)), self.name[first])
        self._join(first, last, name, self_left[first], self_right[last])


def long_spans(words: np.ndarray, doc: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, name) of each two neighbouring symbols of HIGH rounds, and of documents of one symbol, from WINDOW words on."""
    s = Symbols(words, doc, offsets)
    for level in range(1, HIGH + 1):
        s.compress(level)
    if not len(s.name):
        return s.doc, s.start, s.end, s.name
    same = s.doc[1:] == s.doc[:-1]
    i = np.flatnonzero(same)
    alone = np.flatnonzero(~np.r_[False, same] & ~np.r_[same, False])
    doc_, start, end = (np.r_[x[i], x[alone]] for x in (s.doc, s.start, s.end))
    end[: len(i)] = s.end[i + 1]
    name = np.r_[mix(s.name[i] * B + mix(s.name[i + 1]) * C), s.name[alone]]
    ok = end - start >= WINDOW
    return doc_[ok], start[ok], end[ok], name[ok]


def anchors(words: np.ndarray, doc: np.ndarray, offsets: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the anchor of each of the ``windows`` (their first words): what the chosen symbol depends on.

    The symbol is one of the most rounds, up to LOW, that lie in the window with all
    they depend on, and of these the one of the smallest name; ties go to the leftmost.
    """
    levels = [s := Symbols(words, doc, offsets)]
    for level in range(1, LOW + 1):
        t = object.__new__(Symbols)
        t.__dict__.update(s.__dict__)
        t.compress(level)
        levels.append(s := t)
    lo, hi = np.full(len(windows), -1), np.full(len(windows), -1)
    todo = np.arange(len(windows))
    for s in reversed(levels):
        at = windows[todo]
        now, stop = np.searchsorted(s.left, at), np.searchsorted(s.right, at + WINDOW, side="right")
        rank = mix(s.name ^ D)
        best = now.copy()
        some = now < stop
        step, live = 1, np.flatnonzero(now + 1 < stop)
        while len(live):
            other = now[live] + step
            better = rank[other] < rank[best[live]]
            best[live[better]] = other[better]
            step += 1
            live = live[now[live] + step < stop[live]]
        lo[todo[some]], hi[todo[some]] = s.left[best[some]], s.right[best[some]]
        todo = todo[~some]
    return lo, hi


# ---- passes ----------------------------------------------------------------------------------------------------------


class Part:
    """Some documents' words: hashes, document and first word of each document, and the windows that earlier passes haven't removed."""

    def __init__(self, texts: pa.Array, lo: int, buf: np.ndarray, offs: np.ndarray):
        starts, ends, self.offsets = find_words(buf, offs, NOT_SPACE)
        self.words = hash_spans(buf, starts, ends)
        self.first, self.n = lo, len(offs) - 1
        self.doc = np.repeat(np.arange(self.n), np.diff(self.offsets))

    def windows(self, removed: list) -> np.ndarray:
        """First words of the windows that no removed span holds."""
        open_ = np.zeros(len(self.words) + 1, np.int64)
        ok = np.zeros(len(self.words), bool)
        ok[: max(0, len(ok) - WINDOW + 1)] = self.doc[: max(0, len(ok) - WINDOW + 1)] == self.doc[WINDOW - 1 :]
        for i in range(self.n):
            spans = removed[self.first + i]
            if spans is not None:
                at = np.frombuffer(spans, np.int32).reshape(-1, 2) + self.offsets[i]
                np.add.at(open_, at[:, 0], 1)
                np.add.at(open_, at[:, 1] - WINDOW + 1, -1)
        return np.flatnonzero(ok & (np.cumsum(open_[:-1]) == 0))


def _firsts(keys: list[np.ndarray], doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each row is the first, by (doc_id, start), of those with its keys; equal ones are all first."""
    order = np.lexsort((start, doc_id, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[:1], group = True, np.r_[False, new[1:]]
    head = np.maximum.accumulate(np.where(group, 0, np.arange(len(order))))
    first = (doc_id[order] == doc_id[order][head]) & (start[order] == start[order][head])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: What passes one and three tell: a span with its digests, which is to be compared; or, with ``known`` and keys of its row alone, all spans of a row that are known to be repeats.
SPANS = "k1 long, k2 long, row long, doc_id long, start int, stop int, known binary"
#: Pass two: an anchor that the part has once, and its row; or, without row, one that it has more often; or, with ``known`` and its row as key, those of a row.
ANCHORS = "k1 long, row long, known binary"


def _fields(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _groups(row: np.ndarray) -> list[tuple[int, int]]:
    """Where each stretch of one value begins and ends."""
    ends = [*np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)] if len(row) else []
    return list(zip([0, *ends], ends))


def _by_row(row: np.ndarray, entries: np.ndarray, pack: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Rows, and what ``pack`` makes of their entries, as bytes; the entries come row by row."""
    groups = _groups(row)
    return row[[lo for lo, _ in groups]], [pack(entries[lo:hi]).tobytes() for lo, hi in groups]


def _merge(spans: np.ndarray) -> np.ndarray:
    """Spans by their start; those that overlap by a window's length less one, so that no window lies between them, are one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(np.r_[True, spans[1:, 0] + WINDOW > reach[:-1] + 1])
    return np.stack([spans[cut, 0], reach[np.r_[cut[1:], len(spans)] - 1]], 1)


def _spans(row: np.ndarray, doc_id: np.ndarray, start: np.ndarray, stop: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    """SPANS of a part's spans, which come row by row: the first ones of their digests, and the rows' other spans."""
    first = _firsts([k1, k2], doc_id, start)
    rows, known = _by_row(row[~first], np.stack([start[~first], stop[~first]], 1).astype(np.int32), _merge)
    i, n = np.flatnonzero(first), len(rows)
    columns = [
        pa.array(np.r_[_signed(k1[i]), rows]),
        pa.array(np.r_[_signed(k2[i]), np.zeros(n, np.int64)], mask=np.arange(len(i) + n) >= len(i)),
        pa.array(np.r_[row[i], rows]),
        pa.concat_arrays([pa.array(doc_id[i]), pa.nulls(n, pa.int64())]),
        pa.concat_arrays([pa.array(start[i].astype(np.int32)), pa.nulls(n, pa.int32())]),
        pa.concat_arrays([pa.array(stop[i].astype(np.int32)), pa.nulls(n, pa.int32())]),
        pa.concat_arrays([pa.nulls(len(i), pa.binary()), pa.array(known, pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_fields(SPANS))


def _walk(table: DataFrame, ddl: str, visit: Callable) -> DataFrame:
    """``visit`` (part, row ids, doc ids, spans, anchors) on each part of ``table``'s documents."""

    @tidy
    def run(batches):
        for batch in batches:
            for piece in parts(batch):
                rows, ids = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                more = [piece.column(i).to_pylist() for i in range(3, piece.num_columns)]
                for lo, _, buf, offs in slices(piece.column(2)):
                    part = Part(piece.column(2), lo, buf, offs)
                    if len(part.words):
                        yield visit(part, rows[lo : lo + part.n], ids[lo : lo + part.n], *more)

    return table.mapInArrow(run, ddl)


def _long(part: Part, rows: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    doc, start, end, name = long_spans(part.words, part.doc, part.offsets)
    order = np.argsort(doc, kind="stable")
    doc, start, end, name = doc[order], start[order], end[order], name[order]
    at = part.offsets[doc]
    return _spans(rows[doc], ids[doc], start - at, end - at, name, Digests(part.words, 1).of(start, end))


def _anchor_keys(part: Part, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _signed(Digests(part.words, 1).of(lo, hi))


def _anchored(part: Part, rows: np.ndarray, ids: np.ndarray, removed: list) -> pa.RecordBatch:
    lo, hi = anchors(part.words, part.doc, part.offsets, part.windows(removed))
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    place = np.unique(lo[new] * (len(part.words) + 1) + hi[new])
    lo, hi = place // (len(part.words) + 1), place % (len(part.words) + 1)
    key, doc = _anchor_keys(part, lo, hi), part.doc[lo]
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    last = np.r_[first[1:], True][: len(key)]
    once, tell = order[first & last], order[first & ~last]
    more = np.sort(order[~(first & last)])
    told, known = _by_row(rows[doc[more]], key[more], np.unique)
    n = len(once) + len(tell)
    columns = [
        pa.array(np.r_[key[once], key[tell], told]),
        pa.concat_arrays([pa.array(rows[doc[once]]), pa.nulls(len(tell), pa.int64()), pa.array(told)]),
        pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(known, pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_fields(ANCHORS))


def _verified(part: Part, rows: np.ndarray, ids: np.ndarray, removed: list, places: list) -> pa.RecordBatch:
    windows = part.windows(removed)
    told = [np.frombuffer(p or b"", np.int64) for p in places[part.first : part.first + part.n]]
    windows = windows[np.array([len(t) > 0 for t in told])[part.doc[windows]]]
    doc, key = part.doc[windows], _anchor_keys(part, *anchors(part.words, part.doc, part.offsets, windows))
    # Whether a window's document has its anchor among those that occur twice.
    wanted = mix(np.concatenate(told).view(U) ^ mix(np.repeat(np.arange(part.n), [len(t) for t in told]).astype(U)))
    ok = np.isin(mix(key.view(U) ^ mix(doc.astype(U))), wanted)
    at, doc = windows[ok], doc[ok]
    start = at - part.offsets[doc]
    return _spans(rows[doc], ids[doc], start, start + WINDOW, Digests(part.words, 1).of(at, at + WINDOW), Digests(part.words, 2).of(at, at + WINDOW))


def _later(spans: DataFrame) -> DataFrame:
    """(row, start, stop, known) of the SPANS that are known to be repeats, and of those that stand later than another of their digests."""
    first = F.min(F.struct("doc_id", "start")).over(Window.partitionBy("k1", "k2"))
    return spans.withColumn("first", first).where(F.col("known").isNotNull() | (F.struct("doc_id", "start") > F.col("first"))).select("row", "start", "stop", "known")


def _twice(found: DataFrame) -> DataFrame:
    """(row, k1, known) of the ANCHORS that occur twice or more."""
    total = F.sum(F.when(F.col("row").isNull(), 2).otherwise(1)).over(Window.partitionBy("k1", F.col("known").isNotNull()))
    return found.withColumn("total", total).where("known is not null or total > 1 and row is not null").select("row", "k1", F.col("known"))


def _packed(found: DataFrame, name: str, pack: Callable[[np.ndarray], np.ndarray], kind: type, width: int) -> DataFrame:
    """(row, name): what ``pack`` makes of a row's entries, as bytes; an entry is ``width`` numbers, and ``known`` holds many."""

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([int(o[0]) for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["row", name])

    def packed(held):
        return pack(np.concatenate(held).reshape(-1, width) if width > 1 else np.concatenate(held)).tobytes()

    @tidy
    def run(batches):
        now, held = None, []
        for batch in batches:
            row, known = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1)
            single = np.stack([c.fill_null(0).to_numpy() for c in batch.columns[1:-1]], 1).astype(kind)
            many = known.is_valid().to_numpy(zero_copy_only=False)
            out = []
            for lo, hi in _groups(row):
                if row[lo] != now:
                    if held:
                        out.append((now, packed(held)))
                    now, held = row[lo], []
                held.append(single[lo:hi][~many[lo:hi]].ravel())
                held += [np.frombuffer(known[int(i)].as_py(), kind) for i in lo + np.flatnonzero(many[lo:hi])]
            yield table(out)
        if held:
            yield table([(now, packed(held))])

    return stage(found.repartition("row").sortWithinPartitions("row").mapInArrow(run, f"row long, {name} binary"), name, BATCH)


def _bucketed(spark: SparkSession, df: DataFrame, n: int) -> str:
    """``df`` as a table in the shared folder, in ``n`` buckets by row: its name."""
    name, path = f"passages_{uuid.uuid4().hex}", f"{scratch(spark)}/passages-{uuid.uuid4().hex}"
    df.repartition(n, "row").write.format("parquet").bucketBy(n, "row").option("path", path).saveAsTable(name)
    staged.append(path)
    return name


def mark_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words (long), removed (array of disjoint [start, stop) in words, in order) and kept_text (the other words, joined by one space).

    A word is removed if a window of WINDOW consecutive words that holds it stands
    earlier too: in a document of a smaller doc_id, or earlier in its own. Windows are
    judged on the whole input. Null and empty texts have no words; texts of any
    length are read whole (a span number is 32 bits: two thousand million words); a
    null doc_id comes before all others. Rows that repeat a doc_id are versions of one
    document: windows at the same place in them are none earlier than the other, so
    repeated rows keep what a single one keeps. Other columns pass, those named as an
    added one are replaced, and an empty table gives an empty one.

    The documents stay in the shared folder, in a table dealt by row, until it is cleared.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    added = ("n_words", "removed", "kept_text")
    docs = text_column(docs.drop(*[c for c in docs.columns if c.lower() in added and c not in (doc_id, text)]), text)
    rows, names = aliased(docs)
    keyed = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("order", F.coalesce(F.col(names[doc_id]).cast("long"), F.lit(-(1 << 63))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _bucketed(spark, keyed, n)
    table = spark.table(name)
    read = ["row", F.col("order"), F.col(names[text])]

    def beside(*lists: DataFrame) -> DataFrame:
        out = table.select(*read)
        for found in lists:
            out = out.join(found.repartition(n, "row").hint("shuffle_hash"), "row", "left")
        return out

    first = stage(_later(_walk(table.select(*read), SPANS, _long)), "long-repeats", BATCH)
    removed = _packed(first, "removed_", _merge, np.int32, 2)
    places = _packed(_twice(_walk(beside(removed), ANCHORS, _anchored)), "places_", np.unique, np.int64, 1)
    second = _later(_walk(beside(removed, places), SPANS, _verified))
    removed = _packed(first.unionAll(second), "removed_", _merge, np.int32, 2)
    joined = table.join(removed.repartition(n, "row").hint("shuffle_hash"), "row", "left").select(*rows.columns, "removed_")
    width = len(rows.columns)
    at = [joined.columns.index(names[text]), width]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("stop", T.IntegerType(), False)]), False)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("removed", span), T.StructField("kept_text", T.StringType())])
    header = schema.names

    @tidy
    def run(batches):
        for batch in batches:
            for piece in parts(batch):
                count, kept, spans = [], [], []
                texts, removed = piece.column(at[0]), piece.column(at[1]).to_pylist()
                for lo, hi, buf, offs in slices(texts):
                    starts, ends, offsets = find_words(buf, offs, NOT_SPACE)
                    raw = buf.tobytes()
                    for i in range(hi - lo):
                        a, b = offsets[i], offsets[i + 1]
                        gone = np.frombuffer(removed[lo + i] or b"", np.int32).reshape(-1, 2)
                        keep = np.ones(b - a, bool)
                        for x, y in gone:
                            keep[x:y] = False
                        edge = np.flatnonzero(np.diff(keep, prepend=True, append=True))
                        at_ = np.flatnonzero(keep) + a
                        kept.append(b" ".join([raw[s:e] for s, e in zip(starts[at_].tolist(), ends[at_].tolist(), strict=True)]))
                        count.append(int(b - a))
                        spans.append([{"start": int(x), "stop": int(y)} for x, y in edge.reshape(-1, 2)])
                made = [pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], *made], names=header)

    return joined.mapInArrow(run, schema).toDF(*docs.columns, *added)
