"""Column functions of the scoring domain; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEAM_1, TEAM_2 = "team-1", "team-2"
FORCE_BUY, FULL_BUY = 3250, 4200
WIN_BONUS, KILL_REWARD, PLANT_BONUS = 3000, 200, 300
RIFLE = 2900
TRADE_SECONDS = 10
PISTOL_ROUNDS = (1, 13)

# The weight of an elimination by how many the side that loses a
# player has alive (rows, 1 to 5) and how many the other side has (columns, 1 to 5).
ORDER_WEIGHTS = [
    [250, 130, 70, 50, 40],
    [190, 200, 140, 80, 50],
    [120, 170, 180, 130, 90],
    [70, 130, 160, 170, 130],
    [60, 70, 120, 140, 150],
]
DEFAULT_WEIGHT = 100


def winner(outcome: Column) -> Column:
    return F.when(outcome.startswith("Team A"), TEAM_1).when(outcome.startswith("Team B"), TEAM_2)


def attacking_team(round_number: Column) -> Column:
    return F.when(round_number <= 12, TEAM_1).when(round_number <= 24, TEAM_2)


def played(outcome: Column) -> Column:
    """Not a round that only stands for a surrender; an unknown outcome counts as played."""
    return outcome.isNull() | ~outcome.like("%Surrendered Win")


def other_team(team: Column) -> Column:
    return F.when(team == TEAM_1, TEAM_2).when(team == TEAM_2, TEAM_1)


def econ_tier(loadout: Column) -> Column:
    return F.when(loadout < 1000, "SAVE").when(loadout < FORCE_BUY, "ECO").when(loadout < FULL_BUY, "FORCE").when(loadout >= FULL_BUY, "FULL_BUY")


def tier_code(loadout: Column) -> Column:
    return F.when(loadout < 1000, 8).when(loadout < FORCE_BUY, 6).when(loadout < FULL_BUY, 5).when(loadout >= FULL_BUY, 4)


def graph_tier(round_number: Column, mean_loadout: Column) -> Column:
    return F.when(round_number.isin(*PISTOL_ROUNDS), "PISTOL").when(econ_tier(mean_loadout) == "FULL_BUY", "FULL_BUY").otherwise("ECO")


def econ_factor(killer_loadout: Column, victim_loadout: Column, self_kill: Column) -> Column:
    """Tier of the killer over that of the victim; the victim's bare code for a self-kill."""
    return F.when(self_kill, tier_code(victim_loadout).cast("double")).otherwise(tier_code(killer_loadout) / tier_code(victim_loadout))


def self_kill_econ(factor: Column) -> Column:
    return F.when(factor == 4, 0.9).when(factor == 5, 0.85).when(factor == 6, 0.75).otherwise(0.15)


def time_factor(t: Column, planted: Column, plant_time: Column, exploded: Column, defused: Column, defuse_time: Column, for_death: bool = False) -> Column:
    plant = F.when(planted, plant_time)
    over = F.coalesce(exploded & (t >= plant + 45), F.lit(False)) | F.coalesce(defused & (t >= defuse_time), F.lit(False))
    return (
        F.when(over, 0.5)
        .when((t >= plant + 38) & (t <= plant + 45), 0.5 if for_death else 1.75)
        .when(t >= plant, 1 + (t - plant) / 53)
        .otherwise(1.0)
    )


def order_weight(losing_alive: Column, other_alive: Column) -> Column:
    flat = F.array(*[F.lit(w) for row in ORDER_WEIGHTS for w in row])
    known = losing_alive.between(1, 5) & other_alive.between(1, 5)
    return F.when(known, F.element_at(flat, ((losing_alive - 1) * 5 + other_alive).cast("int"))).otherwise(DEFAULT_WEIGHT).cast("double")


def combat_bonus(victims_alive: Column, self_kill: Column) -> Column:
    """What the game's own score adds for an elimination, by how many the victims' side had alive."""
    return F.when(self_kill, 0).otherwise(F.greatest(F.lit(0), 150 - 20 * (5 - victims_alive)))


def clutch_bucket(own: Column, opponents: Column) -> Column:
    return (own == 1) | (own == opponents) | ((own == 2) & (opponents > 2))


def loss_bonus(losses: Column) -> Column:
    """Credits after so many losses since the last win."""
    return F.when(losses == 0, 1900).when(losses == 1, 2400).otherwise(2900)


def combine_swing(predicted: Column, realised: Column) -> Column:
    disagree = (predicted == 1) | (realised == 1) | ((predicted > 1) != (realised > 1))
    return F.when(disagree, 1.0).when(F.abs(realised - 1) > F.abs(predicted - 1), realised).otherwise(predicted)


def terminal_cause(outcome: Column) -> Column:
    cause = F.when(outcome.contains("Elimination"), "ELIMINATION")
    for word in ("Detonate", "Defuse", "Time"):
        cause = cause.when(outcome.contains(word), word.upper())
    return cause


def share(own: Column, other: Column) -> Column:
    """own of own and other; null when both are 0."""
    return F.try_divide(own.cast("double"), (own + other).cast("double"))


def match_won(own: Column, other: Column) -> Column:
    """Null on a tie."""
    return F.when(own > other, True).when(own < other, False)


def rate(wins: Column, total: Column) -> Column:
    return F.try_divide(wins.cast("double"), total.cast("double"))


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)
