"""Models of how long ago a map was last played: rates by map, candidate shapes on a grid, and a test of whole lobbies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import r6, rate
from .sessions import GAP_MOST
from .summaries import in_acts

#: Floors in thousandths and decays in hundredths of the recovery curve, the gaps of its plateau, and where a tail may begin.
FLOORS, DECAYS, PLATEAU, BREAKS = range(0, 151, 5), range(10, 96, 5), (3, 12), range(10, GAP_MOST + 1)


def map_propensity(matches: DataFrame, match_players: DataFrame, acts: DataFrame) -> DataFrame:
    """(map_name, chosen, offered, rate): over all players' matches, how often each map of the act's pool came."""
    played = in_acts(matches, acts).where("map_name is not null")
    pool = played.select("act_id", F.col("map_name").alias("offered")).distinct()
    rows = match_players.select("match_id").join(played.select("match_id", "act_id", "map_name"), "match_id").groupBy("act_id", "map_name").agg(F.count("*").alias("n"))
    sums = rows.join(pool, "act_id").groupBy(F.col("offered").alias("map_name")).agg(F.sum(F.when(F.col("map_name") == F.col("offered"), F.col("n")).otherwise(0)).alias("chosen"), F.sum("n").alias("offered"))
    return sums.select("map_name", "chosen", "offered", r6(rate(F.col("chosen"), F.col("offered"))).alias("rate"))


def _likelihood(p) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.sum(F.col("chosen") * F.log(p) + (F.col("offered") - F.col("chosen")) * F.log(1 - p))


def compare_models(hazard: DataFrame) -> DataFrame:
    """(model, a, b, ll, gain): the best log-likelihood of each shape over (gap, chosen, offered), and twice its gain over one rate for all.

    null: one rate. gap_1: its own rate for a gap of 1. recovery: from a floor a
    towards the plateau's rate, the distance shrinking by b with each game.
    tail: gap_1 with another rate from a gap of a on. Of equals the first of the
    grid wins. The hazard has GAP_MOST rows, which meet a grid of a few hundred.
    """
    spark = hazard.sparkSession
    total = Window.partitionBy()
    n = lambda c, where: F.sum(F.when(where, F.col(c))).over(total)
    share = lambda where: F.try_divide(n("chosen", where), n("offered", where))
    gap = F.col("gap")
    base = hazard.where("offered > 0").select("gap", "chosen", "offered", share(F.lit(True)).alias("p_all"), share(gap == 1).alias("p_1"), share(gap != 1).alias("p_rest"), F.coalesce(share(gap.between(*PLATEAU)), share(F.lit(True))).alias("plateau"))
    null = base.agg(_likelihood(F.col("p_all")).alias("ll")).select(F.lit("null").alias("model"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "ll")
    first = base.where("p_1 is not null and p_rest is not null").groupBy().agg(_likelihood(F.when(gap == 1, F.col("p_1")).otherwise(F.col("p_rest"))).alias("ll")).where("ll is not null").select(F.lit("gap_1"), F.lit(None).cast("double"), F.lit(None).cast("double"), "ll")
    grid = F.broadcast(spark.range(len(FLOORS) * len(DECAYS)).select((F.expr(f"id div {len(DECAYS)}") * FLOORS.step / 1000.0).alias("a"), ((F.col("id") % len(DECAYS) * DECAYS.step + DECAYS.start) / 100.0).alias("b")))
    curve = F.col("plateau") - (F.col("plateau") - F.col("a")) * F.pow("b", F.greatest(gap - 1, F.lit(0)))
    curve = F.least(F.greatest(curve, F.lit(1e-6)), F.lit(1 - 1e-6))
    fits = base.crossJoin(grid).groupBy("a", "b").agg(r6(_likelihood(curve)).alias("ll"))
    best = lambda df: df.agg(F.max_by(F.struct("a", "b", "ll"), F.struct("ll", -F.col("a"), -F.col("b"))).alias("m")).where("m is not null")
    recovery = best(fits).select(F.lit("recovery"), "m.a", "m.b", "m.ll")
    breaks = F.broadcast(spark.range(BREAKS.start, BREAKS.stop).select(F.col("id").cast("double").alias("a")))
    tail = base.crossJoin(breaks)
    w = Window.partitionBy("a")
    part = lambda where: F.try_divide(F.sum(F.when(where, F.col("chosen"))).over(w), F.sum(F.when(where, F.col("offered"))).over(w))
    tail = tail.withColumn("p_mid", part((gap >= 2) & (gap < F.col("a")))).withColumn("p_tail", part(gap >= F.col("a"))).where("p_mid is not null and p_tail is not null and p_1 is not null")
    tail = tail.groupBy("a").agg(r6(_likelihood(F.when(gap == 1, F.col("p_1")).when(gap < F.col("a"), F.col("p_mid")).otherwise(F.col("p_tail")))).alias("ll")).withColumn("b", F.lit(0.0))
    tail = best(tail).select(F.lit("tail"), "m.a", F.lit(None).cast("double"), "m.ll")
    rows = null.unionAll(first).unionAll(recovery).unionAll(tail)
    start = F.max(F.when(F.col("model") == "null", F.col("ll"))).over(total)
    return rows.select("model", "a", "b", r6(F.col("ll")).alias("ll"), F.round(2 * (F.col("ll") - start), 4).alias("gain"))


def lobby_test(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """One row (total, hits, expected, variance, z): how often a match's map was the previous map of any of its players, against what popularity alone would give.

    A match's union of previous maps holds at most as many as there are maps.
    """
    timed = matches.where("played_at is not null").select("match_id", "played_at", "map_name")
    n = timed.groupBy("map_name").agg(F.count("*").alias("n"))
    share = n.select("map_name", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    last = F.lag("map_name").over(Window.partitionBy("player_id").orderBy("played_at", "match_id"))
    before = match_players.select("player_id", "match_id").join(timed, "match_id").withColumn("last", last).where("last is not null").select("match_id", "map_name", F.col("last")).distinct()
    each = before.join(share.withColumnRenamed("map_name", "last"), "last").groupBy("match_id").agg(F.sum("p").alias("p"), F.max((F.col("last") == F.col("map_name")).cast("int")).alias("hit"))
    sums = each.agg(F.count("*").alias("total"), F.sum("hit").alias("hits"), F.sum("p").alias("e"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    return sums.where("total > 0").select("total", "hits", r6(F.col("e")).alias("expected"), r6(F.col("v")).alias("variance"), F.round(F.when(F.col("v") > 0, (F.col("hits") - F.col("e")) / F.sqrt("v")), 4).alias("z"))
