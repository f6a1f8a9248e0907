"""Mergeable bootstrap, SQL table functions, icons from images."""

import random
import shutil
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roundlens.operators import statistics
from roundlens.plans import surface as plans
from roundlens.plans.base import QUERIES
from roundlens.sources import icons, ingest, tables
from roundlens.sources.arena import Arena

SMALL = "/root/testdata/sf0.001"


def test_bootstrap_is_the_same_however_dealt(spark):
    """Against plain sums draw by draw, for three partitionings and for scopes of several columns."""
    rng = random.Random(7)
    rows = [(m, rng.choice("xy"), own, rng.randint(0, 4), rng.randint(0, 4)) for m in range(-3, 60) for own in (1, 2) for _ in range(rng.randint(0, 2))]
    df = spark.createDataFrame(rows, "match_id long, scope string, own long, kills long, deaths long")
    results = [sorted(map(tuple, statistics.bootstrap_rates(df.repartition(n), 100, 5, ["scope", "own"]).collect())) for n in (1, 3, 17)]
    assert results[0] == results[1] == results[2]
    ids = np.array(sorted({r[0] for r in rows}))
    weights = dict(zip(ids.tolist(), statistics.draw_weights(ids, np.arange(100), 5)))  # noqa: B905
    for scope, own, low, high, defined in results[0]:
        cell = [r for r in rows if r[1:3] == (scope, own)]
        rates = []
        for d in range(100):
            k, n = (sum(int(weights[r[0]][d]) * v(r) for r in cell) for v in (lambda r: r[3], lambda r: r[3] + r[4]))
            rates += [k / n] if n else []
        assert defined == len(rates) / 100 and np.allclose([low, high], np.percentile(rates, [2.5, 97.5]), atol=1e-6)
    many = statistics.draw_weights(np.arange(4000), np.arange(50), 1)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02
    assert abs(np.corrcoef(many[:-1].ravel(), many[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(many[:, :-1].ravel(), many[:, 1:].ravel())[0, 1]) < 0.01
    assert statistics.bootstrap_rates(df.limit(0), 10, 1, ["own"]).count() == 0


def test_functions_push_their_arguments_into_scans(spark):
    plans.functions(Arena(spark, SMALL))
    plan = lambda q: spark.sql(q)._jdf.queryExecution().executedPlan().toString()
    rounds = plan("SELECT * FROM match_rounds(12, 3)")
    assert rounds.count("EqualTo(match_id,12)") >= 3 and "EqualTo(round_number,3)" in rounds
    assert plan("SELECT * FROM squad(3)").count("EqualTo(player_id,3)") >= 2 and "EqualTo(player_id,7)" in plan("SELECT * FROM player_career(7)")
    assert spark.sql("SELECT * FROM player_career(-1)").count() == 0 == spark.sql("SELECT * FROM match_rounds(CAST(NULL AS BIGINT), 1)").count()


def png(pixels, colour, way=0):
    """An image of 8 bits, each line filtered in one ``way`` (0 to 4)."""
    height, width = pixels.shape[:2]
    p = pixels.reshape(height, width, -1).astype(np.int64)
    out = b""
    for y in range(height):
        line = []
        for x in range(width):
            a, b, c = (p[y, x - 1] if x else 0 * p[y, x]), (p[y - 1, x] if y else 0 * p[y, x]), (p[y - 1, x - 1] if x and y else 0 * p[y, x])
            guess = [0, a, b, (a + b) // 2, None][way]
            if way == 4:
                da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
            line.append((p[y, x] - guess) & 255)
        out += bytes([way]) + np.concatenate(line).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def drawing(seed, size=36):
    """A smooth random picture."""
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(20, 235, (6, 6))
    at = np.linspace(0, 5, size)
    lo, f = np.minimum(at.astype(int), 4), at - np.minimum(at.astype(int), 4)
    rows = coarse[lo] * (1 - f)[:, None] + coarse[lo + 1] * f[:, None]
    return rows[:, lo] * (1 - f) + rows[:, lo + 1] * f


@pytest.mark.parametrize("way", range(5))
def test_png_filters_and_colours(way):
    rng = np.random.default_rng(way)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = rng.integers(0, 256, (7, 5, n))
        got = icons.decode_png(png(pixels, colour, way))
        grey = pixels[..., 0] if n < 3 else pixels[..., :3] @ [0.299, 0.587, 0.114]
        assert np.allclose(got, grey * (pixels[..., -1] / 255 if n in (2, 4) else 1))
    assert icons.decode_png(b"") is None and icons.decode_png(png(pixels, 6)[:40]) is None and icons.decode_png(b"\x89PNG\r\n\x1a\nxx") is None


def test_saved_icons_get_their_labels(spark, tmp_path):
    for sub in ("known", "seen"):
        (tmp_path / sub).mkdir()
    for k in range(12):
        base = drawing(k)
        (tmp_path / "known" / f"Agent{k}.png").write_bytes(png(base, 0))
        large = np.kron(base, np.ones((2, 2)))
        (tmp_path / "seen" / f"{k}-large.png").write_bytes(png(large, 0, 2))
        tinted = np.stack([0.5 * base + 30, 0.5 * base + 10, 0.5 * base + 60], 2)
        (tmp_path / "seen" / f"{k}-tinted.png").write_bytes(png(tinted, 2, 1))
        (tmp_path / "seen" / f"{k}-small.png").write_bytes(png(icons.shrink(base, 27, 27), 0))
    (tmp_path / "seen" / "other.png").write_bytes(png(drawing(99), 0))
    (tmp_path / "seen" / "broken.png").write_bytes(b"\x89PNG no")
    known = icons.read_icons(spark, str(tmp_path / "known")).select(F.col("name").alias("label"), "hash")
    seen = icons.read_icons(spark, str(tmp_path / "seen"))
    got = {r.icon_id.rsplit("/", 1)[1]: r.label for r in ingest.classify_icons(seen, known).collect()}
    assert len(got) == 38 and got.pop("other.png") == got.pop("broken.png") == "BAD CLASSIFICATION!"
    assert got == {name: f"Agent{name.split('-')[0]}" for name in got}


def test_squad_derives_what_it_reads(spark, tmp_path):
    """A function's query derives the tables of its function, not all that functions read."""
    folder = tmp_path / "in"
    shutil.copytree(SMALL, folder)
    got = QUERIES["s_squad"](spark, str(folder)).collect()
    written = {name for _, source, _, name in tables._kept if source == str(folder)}
    assert written and not written & {"impact", "stats", "kill_events", "matches"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, plans.functions(Arena(spark, SMALL)).sql("SELECT * FROM squad(3)").collect())) and got
