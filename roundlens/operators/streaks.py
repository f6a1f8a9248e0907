"""How long a player has gone without each map of the current act: the run that goes on, and the record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intervals import interval_join
from .sessions import map_windows


def window_gaps(matches: DataFrame, match_players: DataFrame, windows: DataFrame, acts: DataFrame) -> DataFrame:
    """(player_id, map_name, first_act, last_act, best, trailing): runs of a player's matches without the map inside each window of acts that has any of the player's matches.

    ``windows`` (map_name, first_act, last_act) are few: acts times maps at most.
    """
    start, end = acts.select(F.col("act_id").alias("first_act"), "act_start"), acts.select(F.col("act_id").alias("last_act"), "act_end")
    spans = windows.withColumnRenamed("map_name", "wanted").join(start, "first_act").join(end, "last_act")
    rows = match_players.select("player_id", "match_id").join(matches.where("played_at is not null and map_name is not null").select("match_id", "played_at", "map_name"), "match_id")
    rows = interval_join(rows, spans, "played_at", "act_start", "act_end")
    key = ["player_id", "wanted", "first_act", "last_act"]
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("played_at", "match_id"))).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    mine = F.when(F.col("map_name") == F.col("wanted"), F.col("at"))
    before = F.coalesce(F.max(mine).over(Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = rows.select(*key, "n", mine.alias("mine"), (F.col("at") - 1 - before).alias("gap"))
    sums = each.groupBy(*key).agg((F.max("n") - F.coalesce(F.max("mine"), F.lit(0))).alias("trailing"), F.coalesce(F.max(F.when(F.col("mine").isNotNull(), F.col("gap"))), F.lit(0)).alias("gap"))
    return sums.select("player_id", F.col("wanted").alias("map_name"), "first_act", "last_act", F.greatest("gap", "trailing").cast("long").alias("best"), F.col("trailing").cast("long").alias("trailing"))


def map_streaks(matches: DataFrame, match_players: DataFrame, pools: DataFrame, acts: DataFrame) -> DataFrame:
    """Per player and map of the latest act's pool: the current run without it, the longest one in any of its windows, the first of equals, and whether that one still goes on.

    Players without a match in the map's current window are left out.
    """
    latest = acts.agg(F.max("act_id")).first()[0]
    gaps = window_gaps(matches, match_players, map_windows(pools), acts).withColumn("latest", F.lit(latest).cast("long"))
    per = gaps.groupBy("player_id", "map_name", "latest").agg(
        F.max_by(F.struct("first_act", "trailing"), "last_act").alias("c"), F.max("last_act").alias("last"), F.max_by(F.struct("first_act", "last_act", "best", "trailing"), F.struct("best", -F.col("last_act"))).alias("r")
    )
    now = per.where(F.col("last") == F.col("latest"))
    is_now = F.col("r.last_act") == F.col("latest")
    return now.select(
        "player_id", "map_name", F.col("c.first_act").alias("current_from"), F.col("c.trailing").alias("current_gap"), F.col("r.first_act").alias("record_from"), F.col("r.last_act").alias("record_to"), F.col("r.best").alias("record_gap"),
        (is_now & (F.col("r.best") == F.col("r.trailing")) & (F.col("r.best") > 0)).alias("record_ongoing"), (is_now & (F.col("r.best") == F.col("c.trailing"))).alias("record_is_current"),
    )
