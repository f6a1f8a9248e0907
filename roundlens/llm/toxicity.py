"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word comes in twice: as itself (hashed) and as its characters (hashed byte
trigrams with marks for its ends). Both embeddings feed a GRU in each direction
over a window of words; attention pools the states of a window into one logit.
Windows overlap by half and cover the whole text; a document's logit is that of
its worst window, brought to a probability by a line fitted on the same sample.

Labels hold for documents, not windows, so training alternates: it picks each
toxic document's most telling window and clean documents' most misleading ones,
fits the network to these, and picks again. The first picks come from the
odds of words and trigrams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import ALNUM, LOWER, U, aliased, find_words, give_back, hash_spans, map_rows, slices, text_column

WINDOW, STEP = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BITS, CHAR_BITS = 15, 15
#: The network is fitted on at most so many labelled documents of each class, the first by a hash of their id ...
SAMPLE_EACH = 1500
#: ... and of at most so many characters each, so that the sample is bounded in bytes too.
SAMPLE_CHARS = 20_000
PREDICT_AT = 0.3
ROUNDS, EPOCHS, BATCH, RATE = 4, 5, 128, 0.01
#: Gradient steps of a round at least, for small samples.
LEAST_STEPS = 100


class Words:
    """The words of a slice of texts: distinct ones with their inputs, and which one stands where."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        buf = LOWER[buf]
        starts, ends, self.by = find_words(buf, offs, ALNUM)
        hashes = hash_spans(buf, starts, ends)
        distinct, first, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (distinct & U((1 << WORD_BITS) - 1)).astype(np.int64)
        starts, size = starts[first], (ends - starts)[first]
        self.tri_from = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(starts - self.tri_from[:-1], size) + np.arange(self.tri_from[-1])
        here = buf[where].astype(np.int64)
        before, after = np.empty_like(here), np.empty_like(here)
        before[1:], after[:-1] = here[:-1], here[1:]
        if len(size):
            before[self.tri_from[:-1]] = 1
            after[self.tri_from[1:] - 1] = 2
        tri = ((before << 16) | (here << 8) | after).astype(U)
        self.tri = ((tri * U(0x9E3779B97F4A7C15)) >> U(64 - CHAR_BITS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) numbers of distinct words, -1 beyond a text's end, and the text of each window."""
        n = np.diff(self.by)
        count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP)), 0)
        text = np.repeat(np.arange(len(n)), count)
        start = self.by[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP
        where = start[:, None] + np.arange(WINDOW)
        inside = where < self.by[1:][text][:, None]
        got = np.full(where.shape, -1, np.int64)
        got[inside] = self.at[where[inside]]
        return got, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, the forward pass, and the backward pass for training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (0.1 * rng.standard_normal((1 << WORD_BITS, WORD_DIM))).astype(np.float32),
            "char": (0.1 * rng.standard_normal((1 << CHAR_BITS, CHAR_DIM))).astype(np.float32),
            "att": init(2 * h, h), "att_b": np.zeros(h, np.float32), "att_v": init(h),
            "out": init(2 * h), "out_b": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p |= {f"w{way}": init(d, 3 * h), f"u{way}": init(h, 3 * h), f"b{way}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][words.tri], words.tri_from[:-1], axis=0) if len(words.tri) else np.empty((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][words.word], 0.5 * chars], 1)

    def run(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows ``at`` (numbers of rows of ``x``, -1: none), and all states if ``keep``."""
        p, h = self.p, HIDDEN
        mask = (at >= 0).astype(np.float32)
        n = len(at)
        states = np.empty((WINDOW, n, 2 * h), np.float32)
        saved = {}
        for side, way in enumerate("fb"):
            pre = np.concatenate([x @ p[f"w{way}"] + p[f"b{way}"], np.zeros((1, 3 * h), np.float32)])
            now = np.zeros((n, h), np.float32)
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                a, r = pre[at[:, t]], now @ p[f"u{way}"]
                zr = sigmoid(a[:, : 2 * h] + r[:, : 2 * h])
                z, reset = zr[:, :h], zr[:, h:]
                new = np.tanh(a[:, 2 * h :] + reset * r[:, 2 * h :])
                nxt = (new + z * (now - new)) * mask[:, t, None]
                if keep:
                    saved[way, t] = (now, z, reset, new, r[:, 2 * h :])
                now = nxt
                states[t, :, side * h : side * h + h] = now
        hid = np.tanh(states @ p["att"] + p["att_b"])
        e = hid @ p["att_v"] - 1e9 * (1 - mask.T)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        context = np.einsum("tn,tnk->nk", e, states)
        logit = context @ p["out"] + p["out_b"]
        return (logit, (states, hid, e, context, mask, saved)) if keep else logit

    def gradients(self, words: Words, at: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x = self.inputs(words)
        logit, (states, hid, e, context, mask, saved) = self.run(x, at, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = ((sigmoid(logit) - target) / len(at)).astype(np.float32)
        g["out"], g["out_b"] = context.T @ d, d.sum(keepdims=True)
        d_context = d[:, None] * p["out"]
        d_e = np.einsum("nk,tnk->tn", d_context, states)
        d_states = e[:, :, None] * d_context
        d_e = e * (d_e - (e * d_e).sum(0))
        g["att_v"] = np.einsum("tn,tnk->k", d_e, hid)
        d_hid = d_e[:, :, None] * p["att_v"] * (1 - hid * hid)
        g["att"], g["att_b"] = np.einsum("tnk,tnj->kj", states, d_hid), d_hid.sum((0, 1))
        d_states += d_hid @ p["att"].T
        d_x = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for side, way in enumerate("fb"):
            d_pre = np.zeros((len(x) + 1, 3 * h), np.float32)
            later = np.zeros((len(at), h), np.float32)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                now, z, reset, new, r_new = saved[way, t]
                d_now = (d_states[t, :, side * h : side * h + h] + later) * mask[:, t, None]
                d_new = d_now * (1 - z) * (1 - new * new)
                d_z = d_now * (now - new) * z * (1 - z)
                d_reset = d_new * r_new * reset * (1 - reset)
                d_a = np.concatenate([d_z, d_reset, d_new], 1)
                d_r = np.concatenate([d_z, d_reset, d_new * reset], 1)
                g[f"u{way}"] += now.T @ d_r
                later = d_now * z + d_r @ p[f"u{way}"].T
                np.add.at(d_pre, at[:, t], d_a)
            d_pre[-1] = 0
            g[f"w{way}"] = x.T @ d_pre[:-1]
            g[f"b{way}"] = d_pre.sum(0)
            d_x[:-1] += d_pre[:-1] @ p[f"w{way}"].T
        np.add.at(g["word"], words.word, d_x[:-1, :WORD_DIM])
        np.add.at(g["char"], words.tri, np.repeat(0.5 * d_x[:-1, WORD_DIM:], np.diff(words.tri_from), axis=0))
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -60, 60)))


def document_logits(net: Network, words: Words) -> np.ndarray:
    """The largest window logit of each text; -inf for texts without words."""
    at, text = words.windows()
    x = net.inputs(words)
    out = np.full(len(words.by) - 1, -np.inf)
    for k in range(0, len(at), 8192):
        np.maximum.at(out, text[k : k + 8192], net.run(x, at[k : k + 8192]))
    return out


def _slice_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def first_picks(words: Words, at: np.ndarray, text: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A score of each window by the odds of its words and trigrams among toxic and clean texts."""
    count = {"word": np.zeros((2, 1 << WORD_BITS)), "tri": np.zeros((2, 1 << CHAR_BITS))}
    size = np.diff(words.tri_from)
    for k in range(len(words.by) - 1):  # text by text: all pairs of texts and trigrams at once would be ten times the sample
        held = np.unique(words.at[words.by[k] : words.by[k + 1]])
        where = np.repeat(words.tri_from[held] - np.cumsum(size[held]) + size[held], size[held]) + np.arange(size[held].sum())
        toxic = int(target[k] > 0)
        count["word"][toxic, np.unique(words.word[held])] += 1
        count["tri"][toxic, np.unique(words.tri[where])] += 1
    odds = {kind: np.log((c[1] + 0.5) / (target.sum() + 1)) - np.log((c[0] + 0.5) / ((1 - target).sum() + 1)) for kind, c in count.items()}
    tri_of = np.repeat(np.arange(len(words.word)), size)
    by_word = np.maximum(odds["word"][words.word] - 1.5, 0)
    np.add.at(by_word, tri_of, np.maximum(odds["tri"][words.tri] - 1.5, 0))
    return np.where(at >= 0, np.append(by_word, 0)[at], 0).sum(1)


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Network:
    """Fit the network; without texts of both classes it stays at a score near 0 for all."""
    rng = np.random.default_rng(seed)
    net = Network(seed)
    target = np.array(toxic, np.float32)
    words = _slice_of(texts)
    at, text = words.windows()
    if not len(at) or target.min() == target.max():
        net.scale, net.shift = 0.0, -4.0
        return net
    score = first_picks(words, at, text, target) + rng.random(len(at)) * 1e-3
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    hard: list[np.ndarray] = []
    for round_ in range(ROUNDS):
        order = np.lexsort((-score, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        toxic_doc = target[text[order]] > 0
        positive = order[toxic_doc & (rank < 1)]
        hard.append(order[~toxic_doc & (rank < 2)])
        spread = rng.permutation(order[~toxic_doc])[: 2 * len(positive)]
        chosen = np.unique(np.concatenate([positive, *hard, spread]))
        weight = np.where(target[text[chosen]] > 0, max(1, (len(chosen) - len(positive)) // max(1, len(positive)) // 2), 1)
        chosen = np.repeat(chosen, weight)
        batches = max(1, len(chosen) // min(BATCH, max(16, len(chosen) // 12)))
        epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
        for epoch in range(epochs):
            rate = RATE * (1 - 0.8 * (round_ + epoch / epochs) / ROUNDS)
            for batch in np.array_split(rng.permutation(chosen), batches):
                used, where = np.unique(at[batch], return_inverse=True)
                where = where.reshape(at[batch].shape)
                if used[0] < 0:
                    used, where = used[1:], where - 1
                part = _part(words, used)
                step += 1
                for k, g in net.gradients(part, where, target[text[batch]]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    net.p[k] -= (rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        x = net.inputs(words)
        score = np.concatenate([net.run(x, at[k : k + 8192]) for k in range(0, len(at), 8192)])
    best = np.full(len(target), -30.0)
    np.maximum.at(best, text, score)
    _calibrate(net, best, target)
    return net


def _part(words: Words, used: np.ndarray) -> Words:
    part = object.__new__(Words)
    size = np.diff(words.tri_from)[used]
    part.word = words.word[used]
    part.tri_from = np.concatenate([[0], np.cumsum(size)])
    part.tri = words.tri[np.repeat(words.tri_from[used] - part.tri_from[:-1], size) + np.arange(part.tri_from[-1])]
    return part


def _calibrate(net: Network, best: np.ndarray, target: np.ndarray) -> None:
    """A line from logits to log odds, by Newton steps on softened targets."""
    pos, neg = target.sum(), (1 - target).sum()
    soft = np.where(target > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([best, np.ones_like(best)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - soft) + 1e-3 * w
        w -= np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), grad).clip(-2, 2)
    net.scale, net.shift = float(max(w[0], 1e-3)), float(w[1])


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS):
    """(texts, labels) on the driver: at most ``each`` documents of each class and ``chars`` characters a text, held-out ids left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y in (0, 1)").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("r", F.xxhash64("doc_id"))
    some = known.where("y = 1").orderBy("r", "doc_id").limit(each).unionAll(known.where("y = 0").orderBy("r", "doc_id").limit(each))
    texts = text_column(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.length("text") > 0) & (F.length("text") <= chars))
    got = texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy("r", "doc_id").select("text", "y").collect()
    return [r[0] for r in got], [r[1] for r in got]


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on the bounded sample of rows of ``labels`` (doc_id, toxic) that aren't held out."""
    net = train(*labelled_sample(docs, labels, "toxic"))
    give_back()
    return net


def with_toxicity(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with toxicity, a double from 0 to 1: the worst window of each whole text.

    Null and empty texts, and texts without letters or digits, get the score of
    clean text, 0.0. Very long texts are scored window by window to their end; of
    equal worst windows either gives the score. A column named toxicity is
    replaced, all others pass; repeated rows are scored each; an empty table
    gives an empty one. No shuffle.
    """
    docs = text_column(docs, text)
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def per_batch(batch):
        out = [np.empty(0)]
        for _, _, buf, offs in slices(batch.column(at)):
            logit = document_logits(held.value, Words(buf, offs))
            out.append(np.where(np.isfinite(logit), held.value.probability(np.where(np.isfinite(logit), logit, 0)), 0.0))
        return {"toxicity": pa.array(np.concatenate(out), pa.float64())}

    return map_rows(docs, per_batch, [("toxicity", T.DoubleType())])


def drop_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged whatever their names, whose texts score under PREDICT_AT; the network learns from ``corpus``.

    Null and empty texts stay; texts of any length are scored to their end; repeated
    rows and equal scores are judged alike; an empty table gives an empty one.
    """
    rows, names = aliased(docs)
    found = with_toxicity(rows, fit(corpus if corpus is not None else docs, labels), names[text])
    return found.where(F.col("toxicity") < PREDICT_AT).select(*rows.columns).toDF(*docs.columns)
