"""Benchmark decontamination: training passages query a BM25 index of the test items.

Items are indexed in parts of at most ``PART_WORDS`` words. A part's terms have
BM25 weights divided by the part's own total, so one threshold serves all parts.
Each passage (a window of words, half of it shared with the next, so that any
part lies whole in one) is a query. The inverted index is cut into blocks of
parts, and each term has its largest weight over all parts and in each of its
blocks. As in block-max WAND, the terms that are too light to reach the threshold
even together can't nominate a part: only blocks of the other terms are candidates.
The block maxima of all terms bound these, and postings of blocks whose bound is
below the threshold are never read.

An item with a part found counts once its question and its answer (the last
quarter of the item's words, whatever its length) both overlap the passages
found, in word n-grams.

A task holds one shard of the index, of about ``SHARD_WORDS`` words of items. More
items are taken shard by shard, each against all passages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import LOWER, NOT_SPACE, U, aliased, find_words, hash_spans, map_rows, mix, slices, stage, text_column

#: Words of items in a shard of the index, of some 50 bytes each.
SHARD_WORDS = 1_000_000
#: Items are indexed in parts of at most so many words; a passage is two such lengths, and the next begins one length on.
PART_WORDS = 64
BLOCK_PARTS = 16
THRESHOLD = 0.6
OVERLAP = 0.5
GRAM = 5
ANSWER_SHARE = 0.25
K1, B_LENGTH = 1.2, 0.75
#: What rounding may take from a sum of weights.
ROUNDING = 1e-5


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, _, buf, offs in slices(pa.array(texts, pa.string())):
        buf = LOWER[buf]
        starts, ends, by = find_words(buf, offs, NOT_SPACE)
        h = hash_spans(buf, starts, ends)
        out += [h[a:b] for a, b in zip(by, by[1:], strict=False)]
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams; of the whole sequence where it is shorter."""
    n = max(1, min(n, len(h)))
    acc = np.zeros(max(0, len(h) - n + 1), U)
    for k in range(n):
        acc = acc * U(0xC2B2AE3D27D4EB4F) + h[k : len(h) - n + 1 + k]
    return mix(acc + U(n))


@dataclass
class Shard:
    """Inverted index of item parts.

    Postings are sorted by term, then by part. An entry is a term's run of
    postings within one block of parts, with their largest weight; entries are
    sorted by term, then by block. Nothing is kept for terms and blocks that don't meet.
    """

    item: np.ndarray  # of each part, its place among items
    ids: np.ndarray  # of each item
    terms: np.ndarray
    most: np.ndarray  # by term
    first: np.ndarray  # entries of each term
    block: np.ndarray  # of each entry
    block_most: np.ndarray  # of each entry
    start: np.ndarray  # postings of each entry
    posting: np.ndarray
    weight: np.ndarray
    question: list[np.ndarray]  # of each item, its distinct grams
    answer: list[np.ndarray]
    size: list[tuple[int, int]]  # words of a gram of the question and of the answer


def build_shard(items: list[tuple[int, str]]) -> Shard | None:
    """The index of (item_id, text) rows; items without words are left out."""
    ids, words, parts, owner = [], [], [], []
    for (item, _), h in zip(items, word_hashes([t or "" for _, t in items]), strict=True):
        if len(h):
            pieces = np.array_split(h, -(-len(h) // PART_WORDS))
            parts += pieces
            owner += [len(ids)] * len(pieces)
            ids.append(item)
            words.append(h)
    if not parts:
        return None
    length = np.array([len(p) for p in parts], float)
    each = [np.unique(p, return_counts=True) for p in parts]
    term, tf = np.concatenate([u for u, _ in each]), np.concatenate([c for _, c in each]).astype(float)
    part = np.repeat(np.arange(len(parts)), [len(u) for u, _ in each])
    terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    idf = np.log1p((len(parts) - df + 0.5) / (df + 0.5))
    weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B_LENGTH + B_LENGTH * length[part] / length.mean()))
    weight = (weight / np.bincount(part, weight, len(parts))[part]).astype(np.float32)
    order = np.lexsort((part, at))
    at, part, weight = at[order], part[order], weight[order]
    most = np.maximum.reduceat(weight, np.searchsorted(at, np.arange(len(terms))))
    block = part // BLOCK_PARTS
    start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (block[1:] != block[:-1])])
    first = np.searchsorted(at[start], np.arange(len(terms) + 1))
    tail = [max(1, round(len(h) * ANSWER_SHARE)) for h in words]
    asked = [h[: len(h) - k] if len(h) > k else h for h, k in zip(words, tail, strict=True)]
    told = [h[-k:] for h, k in zip(words, tail, strict=True)]
    distinct = lambda hs: [np.unique(grams(h, GRAM)) for h in hs]
    size = [(min(GRAM, len(a)), min(GRAM, len(b))) for a, b in zip(asked, told, strict=True)]
    return Shard(np.array(owner), np.array(ids, np.int64), terms, most, first, block[start], np.maximum.reduceat(weight, start), np.r_[start, len(part)], part, weight, distinct(asked), distinct(told), size)


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of all ranges [first, last), and which range each is of."""
    count = last - first
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count), which


def search(shard: Shard, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, part, score) of all parts that reach the threshold, by block-max WAND over many passages at once; ``passage`` and ``term`` are pairs, each once."""
    limit = THRESHOLD - ROUNDING
    order = np.lexsort((shard.most[term], passage))
    passage, term = passage[order], term[order]
    reach = np.cumsum(shard.most[term], dtype=float)
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    reach -= np.repeat(reach[first] - shard.most[term[first]], np.diff(np.r_[first, len(term)]))
    leading = np.flatnonzero(reach >= limit)
    blocks = int(shard.block.max()) + 1
    entries, of = _ranges(shard.first[term[leading]], shard.first[term[leading] + 1])
    nominated = np.unique(passage[leading][of] * blocks + shard.block[entries])
    if not len(nominated):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    entries, of = _ranges(shard.first[term], shard.first[term + 1])
    key = passage[of] * blocks + shard.block[entries]
    place = np.minimum(np.searchsorted(nominated, key), len(nominated) - 1)
    there = nominated[place] == key
    entries, of, place = entries[there], of[there], place[there]
    bound = np.bincount(place, shard.block_most[entries], len(nominated))
    read = bound[place] >= limit
    posts, of_entry = _ranges(shard.start[entries[read]], shard.start[entries[read] + 1])
    met, which = np.unique(passage[of[read]][of_entry] * len(shard.item) + shard.posting[posts], return_inverse=True)
    score = np.bincount(which, shard.weight[posts], len(met))
    found = score >= limit
    return met[found] // len(shard.item), met[found] % len(shard.item), score[found]


#: Entries of the index that one search touches at most, but for a single passage.
SEARCH_ENTRIES = 1_000_000


def passages_found(shard: Shard, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, float]]:
    """(passage, part, score) of the passages h[lo:hi]."""
    pos = np.searchsorted(shard.terms, h)
    pos[pos == len(shard.terms)] = 0
    known = shard.terms[pos] == h
    gain = np.concatenate([[0.0], np.cumsum(np.where(known, shard.most[pos], 0), dtype=float)])
    some = np.flatnonzero(gain[hi] - gain[lo] >= THRESHOLD - ROUNDING)  # words said again are counted again: a bound
    where, of = _ranges(lo[some], hi[some])
    where, of = where[known[where]], of[known[where]]
    pairs = np.unique(some[of] * len(shard.terms) + pos[where])
    passage, term = pairs // len(shard.terms), pairs % len(shard.terms)
    total = np.bincount(passage, shard.most[term], len(lo))
    reach = total[passage] >= THRESHOLD - ROUNDING
    passage, term = passage[reach], term[reach]
    out: list[tuple[int, int, float]] = []
    if len(passage):
        touched = np.cumsum(shard.first[term + 1] - shard.first[term])
        at = 0
        while at < len(passage):
            stop = int(np.searchsorted(touched, (touched[at - 1] if at else 0) + SEARCH_ENTRIES, side="right"))
            stop = int(np.searchsorted(passage, passage[min(stop, len(passage) - 1)])) if stop < len(passage) else len(passage)
            stop = stop if stop > at else int(np.searchsorted(passage, passage[at], side="right"))
            out += zip(*(x.tolist() for x in search(shard, passage[at:stop], term[at:stop])), strict=True)
            at = stop
    return out


def judge(shard: Shard | None, h: np.ndarray, by: np.ndarray) -> list[list[tuple[int, float, float, float, int]]]:
    """For each document h[by[k]:by[k + 1]] the (item_id, score, question overlap, answer overlap, passages) of the items that it holds."""
    out: list[list[tuple]] = [[] for _ in range(len(by) - 1)]
    count = -(-np.diff(by) // PART_WORDS)
    if shard is None or not count.sum():
        return out
    number, doc = _ranges(np.zeros(len(count), np.int64), count)
    lo = by[doc] + number * PART_WORDS
    hi = np.minimum(lo + 2 * PART_WORDS, by[doc + 1])
    found: dict[tuple[int, int], tuple[set[int], float]] = {}
    for passage, part, score in passages_found(shard, h, lo, hi):
        key = int(doc[passage]), int(shard.item[part])
        held, best = found.get(key, (set(), 0.0))
        found[key] = held | {passage}, max(best, score)
    for (d, item), (held, best) in found.items():
        # Passages that follow each other are one run of words, so that no gram is lost between them.
        runs: list[list[int]] = []
        for c in sorted(held):
            if runs and lo[c] <= runs[-1][1]:
                runs[-1][1] = int(hi[c])
            else:
                runs.append([int(lo[c]), int(hi[c])])
        overlap = []
        for target, n in zip((shard.question[item], shard.answer[item]), shard.size[item], strict=True):
            seen = [grams(h[a:b], n) for a, b in runs if b - a >= n]
            overlap.append(float(np.isin(target, np.concatenate(seen)).mean()) if seen else 0.0)
        if min(overlap) >= OVERLAP:
            out[d].append((int(shard.ids[item]), best, *overlap, len(held)))
    return [sorted(x) for x in out]


HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()), T.StructField("n_passages", T.LongType())])


def hits(shard: Shard | None, texts: pa.Array) -> pa.Array:
    """For each text the benchmark items found, as a list of HIT rows in order of item_id."""
    sizes, flat = [0], []
    for _, _, buf, offs in slices(texts):
        buf = LOWER[buf]
        starts, ends, by = find_words(buf, offs, NOT_SPACE)
        h = hash_spans(buf, starts, ends)
        for items in judge(shard, h, by):
            flat += items
            sizes.append(len(flat))
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, names=HIT.names))


def with_benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with benchmark_hits, an array of HIT in order of item_id: the items that each whole text holds.

    ``benchmark`` has item_id and text. Null and empty texts on either side, and
    items without an id, match nothing; texts of any length are searched passage
    by passage; repeated rows are judged each; items with equal texts are found
    each, and rows that repeat an item_id are items of their own; a column named
    benchmark_hits is replaced, all others pass; an empty table on either side
    gives no hits. The texts aren't shuffled while the benchmark is one shard;
    with more, the rows are written once with a number, and their hits come back by it.
    """
    spark = docs.sparkSession
    rows = text_column(benchmark).select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    kept = [c for c in docs.columns if c.lower() != "benchmark_hits"]
    docs = docs.select(*kept)
    out, names = aliased(text_column(docs, text))
    n = -(-words // SHARD_WORDS)

    def shard(k: int):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        return spark.sparkContext.broadcast(build_shard([(r[0], r[1]) for r in part.orderBy("item_id", "text").collect()]))

    def found_in(df: DataFrame, held) -> DataFrame:
        at = df.columns.index(names[text])
        return map_rows(df, lambda batch: {"benchmark_hits": hits(held.value, batch.column(at))}, [("benchmark_hits", T.ArrayType(HIT))])

    if n <= 1:
        out = found_in(out, shard(0))
    else:
        out = stage(out.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        each = None
        for k in range(n):
            one = found_in(out.select("_row", names[text]), shard(k)).where(F.size("benchmark_hits") > 0).select("_row", "benchmark_hits")
            each = one if each is None else each.unionAll(one)
        each = each.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("benchmark_hits"))).alias("benchmark_hits"))
        out = out.join(each, "_row", "left").withColumn("benchmark_hits", F.coalesce("benchmark_hits", F.array().cast(T.ArrayType(HIT)))).drop("_row")
    return out.toDF(*kept, "benchmark_hits")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row and benchmark item that it holds: doc_id and the fields of HIT."""
    found = with_benchmark_hits(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark)
    return found.select("doc_id", F.explode("benchmark_hits").alias("hit")).select("doc_id", "hit.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged whatever their names, whose texts hold no benchmark item; null and empty texts stay."""
    rows, names = aliased(docs)
    found = with_benchmark_hits(rows, benchmark, names[text])
    return found.where(F.size("benchmark_hits") == 0).select(*rows.columns).toDF(*docs.columns)
