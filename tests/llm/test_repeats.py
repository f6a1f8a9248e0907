"""Periodic runs, repeated passages and hard negatives against plain versions, and on nulls, empty tables, repeats and clashing names."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from roundlens.llm import hard_negatives as H
from roundlens.llm import periodic_runs as P
from roundlens.llm import substring_dedup as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods_tried():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            k, w = rng.choice([1, 2, 2, 3, 8]), []
            for _ in range(rng.randint(0, 5)):
                p = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
                w += (p * 60)[: rng.randint(1, 60)]
            docs.append(w)
        ids, offsets = np.array([x for d in docs for x in d], np.int64), np.r_[0, np.cumsum([len(d) for d in docs])]
        assert P.find_runs(ids, offsets) == [plain_runs(d) for d in docs]


def test_runs_of_very_long_texts_take_n_log_n():
    for w in ([1] * 60_000, [1, 2, 3] * 20_000, list(range(60_000))):
        began = time.time()
        found = P.find_runs(np.array(w), np.array([0, len(w)]))[0]
        assert found == ([] if w[-1] > 3 else [(0, 60_000, len(set(w)))]) and time.time() - began < 20


def test_periodic_runs_table(spark):
    texts = ["a b " * 5 + "c", None, "", " \n", "x", "é " * 6, "é " * 5, "one two three " * 4 + "one\ttail", "a b " * 5 + "c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("RUNS", F.lit("clash")).withColumn("period", F.lit(3))
    got = P.periodic_runs(rows).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        w = WORDS.findall(text or "")
        runs = plain_runs(w)
        assert [(r.start, r.start + r.length, r.period) for r in row.runs] == runs and row.n_words == len(w) and row.period == 3
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in runs))
    assert P.periodic_runs(rows.limit(0)).count() == 0 and P.periodic_runs(spark.sql("select 1 a, null text")).first().n_words == 0


def plain_repeats(rows):
    words, first = [WORDS.findall(t or "") for _, t in rows], {}
    low = lambda d: -(1 << 63) if d is None else d
    for (d, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (low(d), s)), (low(d), s))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] < (low(d), s) for j in range(s, s + 20)}
        out.append((low(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def passages(rng, n):
    """Documents of shared passages, edited copies, periodic texts and own words."""
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "漢字"]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base = [text(rng.randint(1, 700)) for _ in range(10)]
    for _ in range(n):
        r, out = rng.random(), []
        if r < 0.3:
            out = text(rng.randint(0, 300))
        elif r < 0.6:
            for _ in range(rng.randint(1, 4)):
                b = rng.choice(base)
                a = rng.randrange(len(b))
                out += b[a : a + rng.randint(1, 400)] + text(rng.randint(0, 5))
        elif r < 0.8:
            out = list(rng.choice(base))
            out[rng.randrange(len(out))] = "edit"
        else:
            out = text(rng.randint(1, 30)) * rng.randint(1, 30)
        yield rng.choice([" ", "\n", " \t "]).join(out)


def test_repeats_equal_all_windows_compared(spark):
    for seed in (4, 5):
        rng = random.Random(seed)
        rows = [(rng.choice([i, i, i, rng.randint(0, 90)]), t) for i, t in enumerate(passages(rng, 90))]
        rows += [(None, rows[3][1]), (None, None), (500, ""), (501, "a " * 3000), (502, "a " * 3000), rows[5], rows[5]]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("row", F.lit("clash")).withColumn("Removed", F.lit(1))
        got = S.mark_repeats(df).collect()
        shown = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), r.kept_text) for r in got)
        assert shown == plain_repeats(rows) and {r.row for r in got} == {"clash"}
    assert S.mark_repeats(df.limit(0)).count() == 0


def test_repeats_are_read_without_dealing_texts_again(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    plan = S.mark_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_anchors_depend_on_their_window_alone():
    """A window's anchor has the same place in it whatever stands around."""
    rng = np.random.default_rng(8)
    inner = rng.integers(1, 6, 60).astype(np.uint64)
    seen = []
    for _ in range(30):
        around = [rng.integers(1, 6, rng.integers(0, 25)).astype(np.uint64) for _ in range(2)]
        words = np.concatenate([around[0], inner, around[1]])
        at = len(around[0]) + np.arange(41)
        lo, hi = S.anchors(words, np.zeros(len(words), np.int64), np.array([0, len(words)]), at)
        seen.append((tuple(lo - at), tuple(hi - at)))
        assert (lo >= at).all() and (hi <= at + S.WINDOW).all() and (lo < hi).all()
    assert len(set(seen)) == 1


def plain_negatives(rows):
    good = {}
    for i, e, lab in rows:
        if i is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            key = (lab, [int(np.floor(256 * float(np.float32(x)))) for x in e])
            good[i] = min(good.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a, (lab, e) in good.items():
        if a % 50:
            continue
        scored = sorted((-dot(e, f), b, l2) for b, (l2, f) in good.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:5]:
            fits = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 10))
    rows = [(i, [float(x) for x in np.round(centre[i % 3] * 0.4 + rng.normal(size=10) * 0.3, 2)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[7][1], i % 4) for i in range(40)]  # one vector many times: ties
    rows += [(None, [1.0] * 10, 1), (450, None, 1), (451, [float("nan")] * 10, 1), (452, [None] * 10, 1), (453, [float("inf")] * 10, 1), (454, [1.0] * 10, None)]
    rows += [(455, [], 1), (456, [2.0, 1.0], 1), (500, [0.0] * 10, 2), (50, [0.5] * 10, 9), (50, [0.5] * 10, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("anchor", F.lit("clash"))
    want = plain_negatives(rows)
    for block in (H.BLOCK, 3):
        monkeypatch.setattr(H, "BLOCK", block)
        assert sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())) == want and len(want) > 50
    assert H.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(3000, 24)) / 5).astype(np.int64)
    quantiser = H.Quantiser(x[:500])
    codes, left = quantiser.encode(x)
    low, high = quantiser.bounds(*quantiser.tables(x[:40]), codes, left)
    exact = x[:40] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.partition(low, -5)[:, [-5]]).mean() < 0.9
