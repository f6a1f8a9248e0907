"""Credits that players passed on or picked up between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import KILL_REWARD, PISTOL_ROUNDS, PLANT_BONUS, WIN_BONUS, attacking_team, loss_bonus, winner
from .impact import losses_in_a_row

LEAST_BUY, DEFAULT_UTILITY, DEFAULT_FREE = 1000, 650, 0


def credits(stats: DataFrame, rounds: DataFrame, match_players: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """(match_id, round_number, match_player_id, sugar, scavenger) from a player's previous round to this one.

    sugar is what a survivor spent beyond an own outfit, scavenger what a player
    owns beyond what it could pay for. Pistol rounds and players without a
    previous round are left out; the join is on the number of the round before,
    so that missing rounds don't shift. ``agents``: agent_no, utility, free.
    """
    n = F.col("round_number")
    side = losses_in_a_row(rounds).join(rounds.select("match_id", "round_number", winner(F.col("outcome")).alias("w"), "planted"), ["match_id", "round_number"])
    streak = F.when(F.col("w") == F.col("team"), WIN_BONUS).otherwise(loss_bonus(F.col("losses")))
    plant = F.when(F.col("planted") & (attacking_team(n) == F.col("team")), PLANT_BONUS).otherwise(0)
    paid = side.select("match_id", "team", (n + 1).alias("round_number"), (streak + plant).alias("paid"))
    old = stats.select("match_id", (n + 1).alias("round_number"), "match_player_id", *[F.col(c).alias(f"old_{c}") for c in ("remaining", "kills", "deaths", "loadout")])
    rows = stats.where(~n.isin(*PISTOL_ROUNDS)).join(old, ["match_id", "round_number", "match_player_id"]).join(paid, ["match_id", "round_number", "team"])
    if agents is None:
        rows = rows.withColumn("utility", F.lit(DEFAULT_UTILITY)).withColumn("free", F.lit(DEFAULT_FREE))
    else:
        rows = rows.join(match_players.select("match_player_id", "agent_no"), "match_player_id").join(F.broadcast(agents) if agents.count() <= 10_000 else agents, "agent_no", "left").na.fill({"utility": DEFAULT_UTILITY, "free": DEFAULT_FREE})
    cash = F.col("old_remaining") + KILL_REWARD * F.col("old_kills") + F.col("paid")
    own = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("free"))
    lived = F.col("old_deaths") == 0
    sugar = F.when(lived, F.greatest(F.lit(0), F.greatest(F.lit(0), cash - F.col("remaining")) - (LEAST_BUY + F.col("utility")))).otherwise(0)
    found = F.greatest(F.lit(0), F.col("remaining") + own("loadout") - cash - F.when(lived, own("old_loadout")).otherwise(0))
    return rows.select("match_id", "round_number", "match_player_id", sugar.cast("long").alias("sugar"), found.cast("long").alias("scavenger"))
