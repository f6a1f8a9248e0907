"""Quality by hierarchical empirical Bayes over a document classifier and its sites.

A logistic model on a text's hashed words, its byte pairs and a few figures of its
shape gives the document's own evidence. Expected numbers of good documents are then summed by site and by path
within the site over all documents. Each level is a beta posterior: a path is
shrunk to its site and a site to the corpus, by a strength estimated from how
much the level's rates differ beyond chance. The final odds are the document's
likelihood ratio times the prior odds of its path.

Without the document's own part the prior would count it twice, so it is left
out of the sums of its own site and path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import NOT_SPACE, U, aliased, find_words, hash_spans, map_rows, slices, stage, text_column
from .toxicity import is_held_out, labelled_sample

#: The model is fitted on at most so many labelled documents of each class, of at most so many characters each.
SAMPLE_EACH = 2000
SAMPLE_CHARS = 20_000
#: Documents whose probability of being good is lower are rejected.
KEEP_AT = 0.5
#: Evidence is held within these odds, so that no model error outweighs any prior.
MOST_LOGIT = 12.0
#: Words are hashed to so many bits; byte pairs are what they are.
WORD_BITS = 16
PAIRS = 1 << 16
#: Shares are taken as if a text had so many more pairs and words that tell nothing.
MORE_PAIRS, MORE_WORDS = 100, 20
STEPS, RATE, RIDGE = 200, 0.05, 1e-3

_KINDS = [np.array([ok(b) for b in range(256)]) for ok in (lambda b: 0x61 <= b <= 0x7A, lambda b: 0x41 <= b <= 0x5A, lambda b: 0x30 <= b <= 0x39, lambda b: b in (0x0A, 0x0D), lambda b: b >= 0x80)]


class Tokens:
    """Of a slice of texts: its byte pairs and hashed words, case kept, where each text's begin and end, and the shape of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.pairs = (buf[:-1].astype(np.int32) << 8) | buf[1:] if len(buf) > 1 else np.empty(0, np.int32)
        self.pair_lo = np.minimum(offs[:-1], len(self.pairs))
        self.pair_hi = np.maximum(offs[1:] - 1, self.pair_lo)
        starts, ends, by = find_words(buf, offs, NOT_SPACE)
        hashes = hash_spans(buf, starts, ends)
        self.words = (hashes & U((1 << WORD_BITS) - 1)).astype(np.int64)
        self.word_lo, self.word_hi = by[:-1], by[1:]
        size, n = np.diff(offs), np.diff(by)
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=len(n))
        again = np.bincount(owner[1:], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]), len(n)) if len(owner) > 1 else np.zeros(len(n))
        kinds = [np.log1p(1000 * per(kind[buf]) / np.maximum(size, 1)) for kind in _KINDS]
        self.shape = np.stack([*kinds, np.log1p(n), (distinct + 1) / (n + 1), np.log1p(100 * again / np.maximum(n, 1)), np.log1p(size / np.maximum(n, 1))], 1)


def share_sums(weight: np.ndarray, found: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: int) -> np.ndarray:
    """Sums over found[lo:hi] of each text, by the number there and ``more``."""
    sums = np.concatenate([[0.0], np.cumsum(weight[found], dtype=np.float64)])
    return (sums[hi] - sums[lo]) / (hi - lo + more)


class Model:
    """A logistic model on the shares of a text's words and byte pairs, on its shape and the shape's products; ``base`` is the sample's log odds, taken out of the evidence."""

    def __init__(self, texts: list[str], y: list[int]):
        self.w = None
        target = np.array(y, float)
        if not len(texts) or target.min() == target.max():
            return
        row, col, share, shape = [], [], [], []
        for k, text in enumerate(texts):
            raw = np.frombuffer(text.encode(), np.uint8)
            t = Tokens(raw, np.array([0, len(raw)]))
            shape.append(t.shape)
            for found, shift, more in ((t.pairs, 0, MORE_PAIRS), (t.words, PAIRS, MORE_WORDS)):
                if len(found):
                    u, c = np.unique(found, return_counts=True)
                    row.append(np.full(len(u), k))
                    col.append(u + shift)
                    share.append(c / (len(found) + more))
        shape = np.concatenate(shape)
        self.mean, self.std = shape.mean(0), shape.std(0) + 1e-6
        self._fit(np.concatenate(row), np.concatenate(col), np.concatenate(share), self._expand(shape), target)

    def _expand(self, shape: np.ndarray) -> np.ndarray:
        z = np.clip((shape - self.mean) / self.std, -4, 4)
        i, j = np.triu_indices(z.shape[1])
        return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], 1)

    def _fit(self, row: np.ndarray, col: np.ndarray, share: np.ndarray, dense: np.ndarray, y: np.ndarray) -> None:
        """Full-batch gradient steps with moments; shares are scaled by their size over the sample, rare ones less."""
        n = len(y)
        used, col = np.unique(col, return_inverse=True)
        scale = 1 / (np.sqrt(np.bincount(col, share * share) / n) + 3e-3)
        x = share * scale[col]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        w = np.zeros(len(used) + dense.shape[1])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            q = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[col], n) + dense @ w[len(used) :], -30, 30)))
            g = np.append(np.bincount(col, x * (q - y)[row]) / n, dense.T @ (q - y) / n) + RIDGE * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (1 - 0.9 * step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w = np.zeros(PAIRS + (1 << WORD_BITS), np.float32)
        self.w[used] = w[: len(used)] * scale
        self.dense = w[len(used) :]

    def evidence(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of good against bad of each text of a slice; 0 where nothing was learnt."""
        if self.w is None:
            return np.zeros(len(offs) - 1)
        t = Tokens(buf, offs)
        got = share_sums(self.w[:PAIRS], t.pairs, t.pair_lo, t.pair_hi, MORE_PAIRS) + share_sums(self.w[PAIRS:], t.words, t.word_lo, t.word_hi, MORE_WORDS)
        return np.clip(got + self._expand(t.shape) @ self.dense - self.base, -MOST_LOGIT, MOST_LOGIT)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the document model on the bounded sample of rows of ``labels`` (doc_id, quality) that aren't held out."""
    return Model(*labelled_sample(docs, labels, "quality", SAMPLE_EACH, SAMPLE_CHARS))


def with_evidence(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with evidence, the document's log likelihood ratio.

    Null and empty texts get that of a text without words; very long texts are
    read whole; repeated rows are scored each; a column named evidence is
    replaced; an empty table gives an empty one. No shuffle.
    """
    docs = text_column(docs, text)
    at = docs.columns.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def per_batch(batch):
        out = [np.empty(0)] + [held.value.evidence(buf, offs) for _, _, buf, offs in slices(batch.column(at))]
        return {"evidence": pa.array(np.concatenate(out), pa.float64())}

    return map_rows(docs, per_batch, [("evidence", T.DoubleType())])


def _strength(levels: DataFrame, n: str, good: str, mean: Column) -> tuple[float, float]:
    """How many documents a level's prior is worth, by moments over (n, good) rows; 1e6 where the rates don't differ."""
    r = F.col(good) / F.col(n)
    row = levels.where(F.col(n) > 0).agg(F.count("*"), F.sum(n), F.sum(F.col(n) * F.pow(r - mean, F.lit(2))), F.sum(F.col(n) * mean * (1 - mean)), F.sum(F.pow(n, F.lit(2)))).first()
    if not row[0] or row[0] < 2 or not row[3]:
        return 1e6
    groups, total, between, within, squares = (float(v) for v in row)
    rate_var = within / total
    excess = between - groups * rate_var
    spread = excess / max(total - squares / total, 1e-9)
    return 1e6 if spread <= rate_var * 1e-6 else min(max(rate_var / spread - 1, 1.0), 1e6)


def posterior(scored: DataFrame, site: Column, path: Column, rate: float) -> DataFrame:
    """``scored``, which has evidence, with site_prior, path_prior and quality, doubles.

    ``site`` and ``path`` are expressions of the host and the section within it;
    nulls are a site and a path of their own. ``rate`` is the share of good ones
    among labels; quality is the posterior probability of a good document.
    Columns of these names are replaced, and _site, _path, _pn, _pg, _sn and _sg
    are taken; repeated rows count each; equal evidence on one path gives equal
    quality; an empty table gives an empty one. ``scored`` is read twice, so it
    should be a written table. The sums have a row for each path and task,
    whatever a site's share, and are joined back by site and path.
    """
    base = float(np.log(rate / (1 - rate)))
    own = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(base))))
    named = lambda df: df.withColumn("_site", F.coalesce(site.cast("string"), F.lit("\x00"))).withColumn("_path", F.coalesce(path.cast("string"), F.lit("\x00")))
    paths = named(scored).groupBy("_site", "_path").agg(F.count("*").cast("double").alias("_pn"), F.sum(own).alias("_pg"))
    paths = stage(paths, "paths")
    sites = paths.groupBy("_site").agg(F.sum("_pn").alias("_sn"), F.sum("_pg").alias("_sg"))
    total = sites.agg(F.sum("_sn"), F.sum("_sg")).first()
    mean = min(max((total[1] + 1) / (total[0] + 2), 1e-4), 1 - 1e-4) if total[0] else 0.5
    k_site = _strength(sites, "_sn", "_sg", F.lit(mean))
    both = paths.join(sites, "_site")
    site_rate = lambda n, g: (g + k_site * mean) / (n + k_site)
    k_path = _strength(both, "_pn", "_pg", site_rate(F.col("_sn"), F.col("_sg")))
    bounded = F.least(F.greatest(F.col("path_prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        named(scored)
        .join(both, ["_site", "_path"], "left")
        .withColumn("site_prior", site_rate(F.col("_sn") - 1, F.col("_sg") - own))
        .withColumn("path_prior", (F.col("_pg") - own + k_path * F.col("site_prior")) / (F.col("_pn") - 1 + k_path))
        .withColumn("quality", 1 / (1 + F.exp(-(F.col("evidence") + F.log(bounded / (1 - bounded))))))
        .drop("_site", "_path", "_pn", "_pg", "_sn", "_sg")
    )


def label_rate(labels: DataFrame) -> float:
    """The share of good ones among all labels that aren't held out, kept off 0 and 1."""
    n, good = labels.where("quality in (0, 1)").where(~is_held_out()).agg(F.count("*"), F.sum("quality")).first()
    return (float(good or 0) + 1) / (n + 2)


def drop_low_quality(docs: DataFrame, labels: DataFrame, site: str, path: str, corpus: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged whatever their names, whose quality is at least KEEP_AT; the model learns from ``corpus``.

    Texts are scored once, whole, and written with their evidence. Null and empty texts
    have no evidence of their own and are judged by their site and path, of which null is
    one more; repeated rows count each in the posteriors; equal scores are judged
    alike; an empty table gives an empty one.
    """
    model = fit(corpus if corpus is not None else docs, labels)
    rows, names = aliased(docs)
    scored = stage(with_evidence(rows, model, names[text]), "evidence")
    found = posterior(scored, F.col(names[site]), F.col(names[path]), label_rate(labels))
    return found.where(F.col("quality") >= KEEP_AT).select(*rows.columns).toDF(*docs.columns)
