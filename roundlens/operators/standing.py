"""What a player did given who was standing: even fights, comebacks, the other side's best and worst, last ones alive.

All are read off the set replay of a played round, in which a player's first death counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import TEAM_1, TEAM_2, played
from .replay import ROUND, clutches, set_replay


def fraggers(stats: DataFrame) -> DataFrame:
    """(match_id, team, top, bottom): the players of a side with most and fewest kills, the lowest id of equals."""
    sums = stats.groupBy("match_id", "team", "match_player_id").agg(F.sum("kills").alias("kills"))
    order = lambda k: F.struct(k.alias("k"), F.col("match_player_id").alias("id"))
    return sums.groupBy("match_id", "team").agg(F.min(order(-F.col("kills"))).getField("id").alias("top"), F.min(order(F.col("kills"))).getField("id").alias("bottom"))


def standing_counters(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, stats: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """Per match player: kills in even fights and while outnumbered, kills of the other side's top fragger, deaths to its bottom fragger, and full wipes that the player was the last to fall in."""
    rows = (set_replay(feed, match_players) if replayed is None else replayed).join(rounds.where(played(F.col("outcome"))).select(*ROUND), ROUND, "left_semi")
    best = fraggers(stats)
    rows = rows.join(best.select("match_id", F.col("team").alias("victim_team"), "top"), ["match_id", "victim_team"], "left").join(best.select("match_id", F.col("team").alias("killer_team"), "bottom"), ["match_id", "killer_team"], "left")
    fight = F.coalesce((F.col("killer") != F.col("victim")) & (F.col("killer_team") != F.col("victim_team")), F.lit(False))
    alive = lambda team: F.when(team == TEAM_1, F.col("alive_1")).when(team == TEAM_2, F.col("alive_2"))
    own, opp = alive(F.col("killer_team")), alive(F.col("victim_team"))
    size = match_players.groupBy("match_id", "team").agg(F.count("*").alias("size")).withColumnRenamed("team", "victim_team")
    rows = rows.join(size, ["match_id", "victim_team"], "left")
    left = F.when(F.col("victim_team") == TEAM_1, F.col("left_1")).otherwise(F.col("left_2"))
    one = lambda flag: F.when(flag, 1).otherwise(0)
    zero = F.lit(0)
    killer = F.struct(F.col("killer").alias("id"), one(fight & (own == opp) & (own > 0)).alias("xvx"), one(fight & (own < opp)).alias("changer"), one(fight & (F.col("victim") == F.col("top"))).alias("top"), zero.alias("bottom"), zero.alias("last"))
    victim = F.struct(F.col("victim").alias("id"), zero.alias("xvx"), zero.alias("changer"), zero.alias("top"), one(fight & (F.col("killer") == F.col("bottom"))).alias("bottom"), one((left == 0) & (F.col("size") == 5)).alias("last"))
    each = rows.select("match_id", F.explode(F.array(killer, victim)).alias("p")).where("p.id is not null")
    names = {"xvx": "even_fight_kills", "changer": "outnumbered_kills", "top": "kills_of_top", "bottom": "deaths_to_bottom", "last": "last_in_wipe"}
    return each.groupBy("match_id", F.col("p.id").alias("match_player_id")).agg(*[F.sum(f"p.{k}").alias(v) for k, v in names.items()])


def clutch_resolvers(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """(match_id, round_id, match_player_id): the players still standing in the state that their side won a clutch from."""
    replayed = set_replay(feed, match_players) if replayed is None else replayed
    won = clutches(feed, rounds, match_players, replayed)
    fell = replayed.where("first_death").select(*ROUND, F.col("victim").alias("match_player_id"), F.col("seq").alias("fell"))
    team = won.join(match_players.select("match_id", "match_player_id", "team"), ["match_id", "team"])
    return team.join(fell, [*ROUND, "match_player_id"], "left").where("fell is null or fell > seq").select(*ROUND, "match_player_id")
