r"""Periodic runs of words by divide and conquer.

Words are interned as numbers. A document is halved again and again; each run
lies whole within one of the nodes, on both sides of its midpoint, and has half
of its words or more on one of them. Z-functions of the half on that side, and of
the node read away from it, give for every period at once how far the
repetition that crosses the midpoint goes right and left (Main and Lorentz). A
repetition that could go on beyond its node belongs to a node around it; equal
intervals keep their smallest period.

The nodes of one depth are looked at together, those of many documents at a
time: a run needs the words beside the midpoint to come again one period on,
and only nodes where some period has that are worth their Z-functions. These take
time linear in the node, so a document takes n log n at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkit import NOT_SPACE, U, find_words, hash_spans, map_rows, mix, slices, text_column

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4
#: Nodes smaller than so hold no run.
_SMALL = LEAST
#: Words beside the midpoint that are compared at once for periods of so many words or more.
_GRAM = 4
#: Positions compared at a time.
_AT_ONCE = 1 << 20


def z_function(x: list[int]) -> list[int]:
    """For each place, how many items from there on equal those at the beginning."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def right_runs(x: list[int], m: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions of ``x`` around place ``m`` with two periods or more right of it, one word or more left of it, and LEAST words and TIMES periods in all.

    They reach as far as they can within ``x``; of those of one interval the first has the smallest period.
    """
    right = x[m:]
    ahead = z_function(right)
    found = []
    periods = [q for q in range(1, min(len(x) // TIMES, len(right) // 2) + 1) if ahead[q] >= q]
    if not periods:
        return found
    # The words before the midpoint, backwards, against those before each place right of it.
    most = periods[-1]
    back = z_function(x[m - 1 :: -1] + [-1] + x[m + most - 1 :: -1] if m else [])
    seen = set()
    for q in periods:
        behind = min(back[m + 1 + most - q], m) if m else 0
        start, end = m - behind, m + q + ahead[q]
        if behind and end - start >= max(LEAST, TIMES * q) and (start, end) not in seen:
            seen.add((start, end))
            found.append((start, end, q))
    return found


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for the ``n`` words from each place on; the last ones reach beyond the end and equal nothing of use."""
    out = mix(ids.astype(U) + U(n))
    for k in range(1, n):
        later = np.zeros(len(ids), U)
        later[: max(0, len(ids) - k)] = ids[k:]
        out = mix(out * U(0x9E3779B97F4A7C15) + later)
    return out


class _Sides:
    """Words and their grams, forwards and backwards, to ask which nodes may have a run that is mostly right of their midpoint."""

    def __init__(self, ids: np.ndarray):
        self.grams = {n: _grams(ids, n) for n in range(2, _GRAM + 1)}
        self.size = len(ids)
        self.twice = np.zeros(len(ids) + 1, bool)  # a gram that doesn't come again promises nothing
        order = np.argsort(self.grams[_GRAM], kind="stable")
        same = self.grams[_GRAM][order][1:] == self.grams[_GRAM][order][:-1]
        self.twice[order[1:][same]] = self.twice[order[:-1][same]] = True

    def promising(self, mid: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words from ``mid`` on come again some period later, for nodes with ``right`` words from there on, of ``size`` in all."""
        out = np.zeros(len(mid), bool)
        most = np.minimum(size // TIMES, right // 2)
        for q in range(1, _GRAM):
            n = max(2, q)  # a run of one word has three on its longer side, so two pairs of neighbours
            at = np.flatnonzero((most >= q) & (right >= q + n))
            out[at] |= self.grams[n][mid[at]] == self.grams[n][mid[at] + q]
        at = np.flatnonzero(~out & (most >= _GRAM))
        at = at[self.twice[mid[at]]]
        gram = self.grams[_GRAM]
        count = most[at] - _GRAM + 1
        ends = np.cumsum(count)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _AT_ONCE, side="right")))
            n = count[lo:hi]
            which = np.repeat(np.arange(lo, hi), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + _GRAM
            middle = mid[at[which]]
            out[at[which[gram[middle] == gram[middle + offset]]]] = True
            lo = hi
        return out


def find_runs(ids: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each document of ``ids`` its runs (start, end, period), by start and then period; ``offsets`` are the documents' first words and the end."""
    out: list[dict] = [{} for _ in range(len(offsets) - 1)]
    if not len(ids):
        return [[] for _ in out]
    forward, backward = _Sides(ids), _Sides(ids[::-1])
    doc, lo, hi = np.arange(len(out)), np.array(offsets[:-1]), np.array(offsets[1:])
    while True:
        keep = hi - lo >= _SMALL
        doc, lo, hi = doc[keep], lo[keep], hi[keep]
        if not len(doc):
            break
        mid = (lo + hi) // 2
        ahead = forward.promising(mid, hi - mid, hi - lo)
        behind = backward.promising(len(ids) - mid, mid - lo, hi - lo)
        for i in np.flatnonzero(ahead | behind):
            a, b, m, d = int(lo[i]), int(hi[i]), int(mid[i]), int(doc[i])
            x = ids[a:b].tolist()
            n = b - a
            runs = right_runs(x, m - a) if ahead[i] else []
            if behind[i]:
                runs += [(n - end, n - start, q) for start, end, q in right_runs(x[::-1], b - m)]
            for start, end, q in runs:
                s, e = a + start, a + end
                if (start or a == offsets[d] or ids[a - 1] != ids[a - 1 + q]) and (end < n or b == offsets[d + 1] or ids[b] != ids[b - q]):
                    key = (s - int(offsets[d]), e - int(offsets[d]))
                    out[d][key] = min(q, out[d].get(key, q))
        doc, lo, hi = np.concatenate([doc, doc]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return [sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2])) for found in out]


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
ADDED = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN, False)), ("collapsed", T.StringType())]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words (long), runs (array of start, length and period, in words, by start and then period) and collapsed (the text's words without the repetitions, joined by one space).

    A run is a stretch of words with a smallest period of q, of LEAST words and TIMES
    periods at least, that can't be extended; runs may overlap. A word is left out
    of collapsed if a run holds it behind that run's first period. Null and empty
    texts have no words and no runs; texts of any length are read whole, in time
    n log n; repeated rows are read each, so none depends on another and there are no
    ties; columns named as an added one are replaced and all others pass; an empty
    table gives an empty one. No shuffle.
    """
    docs = text_column(docs, text)
    at = docs.columns.index(text)

    def per_batch(batch):
        count, runs, collapsed = [], [], []
        for lo, hi, buf, offs in slices(batch.column(at)):
            starts, ends, offsets = find_words(buf, offs, NOT_SPACE)
            _, ids = np.unique(hash_spans(buf, starts, ends), return_inverse=True)
            raw = buf.tobytes()
            for i, found in enumerate(find_runs(ids, offsets)):
                a, b = offsets[i], offsets[i + 1]
                keep = np.ones(b - a, bool)
                for s, e, q in found:
                    keep[s + q : e] = False
                left = np.flatnonzero(keep) + a
                collapsed.append(b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]))
                count.append(int(b - a))
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
        kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
        return {"n_words": pa.array(count, pa.int64()), "runs": pa.array(runs, kind), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    return map_rows(docs, per_batch, ADDED)
