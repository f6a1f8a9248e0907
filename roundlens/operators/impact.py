"""Impact: what each player's eliminations and deaths were worth in each round.

All steps are keyed by round within match: running counts over the feed stand
for the alive counts, a self-join on the round finds trades, and two keyed
aggregations (killer and victim) give the sums. Nothing is collected, and the
largest group is one round's feed.

Where the feed is incomplete: an elimination without a killer gives no one credit
and counts for the victim as a self-kill does; a round that is missing or has no
outcome counts as lost when losses in a row are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import (
    FULL_BUY,
    KILL_REWARD,
    PLANT_BONUS,
    RIFLE,
    TEAM_1,
    TEAM_2,
    TRADE_SECONDS,
    WIN_BONUS,
    attacking_team,
    clutch_bucket,
    combat_bonus,
    combine_swing,
    econ_factor,
    loss_bonus,
    order_weight,
    other_team,
    self_kill_econ,
    tier_code,
    time_factor,
    winner,
)
from ..sources.tables import as_it_lies


def with_teams(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """The feed with killer_team and victim_team; null for players who aren't of the match."""
    teams = match_players.select("match_id", "match_player_id", "team")
    one = lambda who: as_it_lies(teams.select("match_id", F.col("match_player_id").alias(who), F.col("team").alias(f"{who}_team")))
    return feed.join(one("killer"), ["match_id", "killer"], "left").join(one("victim"), ["match_id", "victim"], "left")


def losses_in_a_row(rounds: DataFrame) -> DataFrame:
    """(match_id, round_number, team, losses): rounds without a win directly before this one, by team; a missing round is a lost one."""
    won = Window.partitionBy("match_id", "team").orderBy("round_number").rowsBetween(Window.unboundedPreceding, -1)
    sides = rounds.select("match_id", "round_number", winner(F.col("outcome")).alias("w"), F.explode(F.array(F.lit(TEAM_1), F.lit(TEAM_2))).alias("team"))
    last = F.coalesce(F.max(F.when(F.col("w") == F.col("team"), F.col("round_number"))).over(won), F.lit(0))
    return sides.select("match_id", "round_number", "team", (F.col("round_number") - 1 - last).alias("losses"))


def swing_risk(rounds: DataFrame, stats: DataFrame) -> DataFrame:
    """(match_id, round_number, team, risk, realised, swing): how far a round's result moves the next rounds' economy."""
    n = F.col("round_number")
    side = stats.join(as_it_lies(rounds.select("match_id", "round_number", "planted")), ["match_id", "round_number"]).join(as_it_lies(losses_in_a_row(rounds)), ["match_id", "round_number", "team"])
    money = F.col("remaining") + KILL_REWARD * F.col("kills") + F.when(F.col("planted") & (attacking_team(n) == F.col("team")), PLANT_BONUS).otherwise(0)
    lost = money + loss_bonus(F.col("losses"))
    count = lambda c: F.count_if(c)
    sums = side.groupBy("match_id", "round_number", "team").agg(
        count(lost < FULL_BUY).alias("cant"),
        count((lost >= FULL_BUY) & (lost < FULL_BUY + RIFLE)).alias("can"),
        count(lost >= FULL_BUY + RIFLE).alias("double"),
        count((money + WIN_BONUS >= FULL_BUY) & (money + WIN_BONUS < FULL_BUY + RIFLE)).alias("win"),
        count(money + WIN_BONUS >= FULL_BUY + RIFLE).alias("win_double"),
        count(F.col("deaths") > 0).alias("need"),
        count(F.col("loadout") >= FULL_BUY).alias("bought"),
        count(F.col("loadout") < FULL_BUY).alias("short"),
    )
    cant, can, double, need, bought = (F.col(c) for c in ("cant", "can", "double", "need", "bought"))
    factor = F.bround((bought + cant - double + 3) * F.lit(0.01), 2)
    low = F.bround(F.lit(0.7) - F.bround((can + 2 * double) * F.lit(0.05), 2) + bought * factor, 1)
    second = F.bround(1 + cant * F.lit(0.15) + (need - can) * F.lit(0.1), 2)
    other = F.bround(1 + (F.lit(0.67) * (bought * factor) + cant * factor) + (need - (F.col("win") + 2 * F.col("win_double"))) * factor, 2)
    risk = (
        F.when(n.isin(1, 13), 1.5)
        .when(n.isin(12, 24) | (n > 24), 1.0)
        .when(can + 2 * double >= 5, low)
        .when(n.isin(2, 14), second)
        .when(can + double < 5, other)
        .otherwise(1.0)
    )
    following = Window.partitionBy("match_id", "team").orderBy("round_number")
    after = F.when(F.lead("round_number").over(following) == n + 1, F.lead("short").over(following))
    realised = F.when(n.isin(12, 24) | (n > 24) | F.col("denied").isNull(), 1.0).otherwise(F.bround(F.lit(0.5) + F.lit(0.2) * F.col("denied"), 2))
    both = sums.withColumn("risk", risk).withColumn("denied", after).withColumn("realised", realised)
    return both.select("match_id", "round_number", "team", "risk", "realised", combine_swing(F.col("risk"), F.col("realised")).alias("swing"))


def alive_counts(feed: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """The feed (with teams) with alive_1 and alive_2 before each row; a victim who appears again later was revived and isn't counted out.

    ``bare`` is the feed as it was before it got its teams, which tells the last appearances as well.
    """
    seen = (feed if bare is None else bare).select("match_id", "round_id", F.explode(F.array_distinct(F.array("killer", "victim"))).alias("p"), "seq").where("p is not null").groupBy("match_id", "round_id", "p").agg(F.max("seq").alias("last"))
    rows = feed.join(as_it_lies(seen.withColumnRenamed("p", "victim")), ["match_id", "round_id", "victim"], "left")
    rows = rows.withColumn("self_kill", F.col("killer").isNull() | (F.col("killer") == F.col("victim"))).withColumn("side", F.coalesce("killer_team", "victim_team"))
    rows = rows.withColumn("hit", F.when(F.col("self_kill"), F.col("side")).otherwise(other_team(F.col("side"))))
    before = Window.partitionBy("match_id", "round_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = lambda team: F.lit(5) - F.coalesce(F.sum(F.when((F.col("hit") == team) & (F.col("last") == F.col("seq")), 1).otherwise(0)).over(before), F.lit(0))
    return rows.withColumn("alive_1", out(TEAM_1)).withColumn("alive_2", out(TEAM_2)).drop("last")


def trades(feed: DataFrame) -> DataFrame:
    """(match_id, round_id, kill_id, traded, trader): eliminations answered within TRADE_SECONDS by a teammate of the victim, the first answer each."""
    first = feed.where("killer <> victim and killer_team <> victim_team").select("match_id", "round_id", "kill_id", "t", F.col("killer").alias("target"), F.col("victim").alias("traded"), F.col("victim_team").alias("team"))
    answer = feed.where("killer <> victim").select("match_id", "round_id", F.col("seq").alias("s2"), F.col("t").alias("t2"), F.col("victim").alias("target"), F.col("killer").alias("trader"), F.col("killer_team").alias("team"))
    met = first.join(as_it_lies(answer), ["match_id", "round_id", "target", "team"]).where(f"t2 - t between 0 and {TRADE_SECONDS}")
    return met.groupBy("match_id", "round_id", "kill_id", "traded").agg(F.min_by("trader", "s2").alias("trader"))


def kill_factors(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, stats: DataFrame, swings: DataFrame | None = None) -> DataFrame:
    """A row per elimination with all factors that impact sums up; ``swings`` is swing_risk where it is known already."""
    rows = alive_counts(with_teams(feed, match_players), feed)
    later = feed.select("match_id", "round_id", F.col("victim").alias("killer"), F.col("t").alias("t2"))
    revenge = feed.where("killer <> victim").select("match_id", "round_id", "kill_id", "killer", "t").join(as_it_lies(later), ["match_id", "round_id", "killer"]).where(f"t2 - t between 0 and {TRADE_SECONDS}")
    revenge = revenge.groupBy("match_id", "round_id", "kill_id").agg((F.min(F.col("t2") - F.col("t")) / TRADE_SECONDS).alias("traded_factor"))
    load = stats.select("match_id", "round_id", F.col("match_player_id").alias("killer"), F.col("loadout").alias("killer_loadout"))
    load_v = load.select("match_id", "round_id", F.col("killer").alias("victim"), F.col("killer_loadout").alias("victim_loadout"))
    swing = (swing_risk(rounds, stats) if swings is None else swings).select("match_id", "round_number", F.col("team").alias("swing_team"), "swing")
    info = rounds.select("match_id", "round_id", "round_number", "planted", "plant_time", "exploded", "defused", "defuse_time")
    rows = rows.join(as_it_lies(revenge), ["match_id", "round_id", "kill_id"], "left").join(as_it_lies(load), ["match_id", "round_id", "killer"], "left").join(as_it_lies(load_v), ["match_id", "round_id", "victim"], "left").join(as_it_lies(info), ["match_id", "round_id"])
    rows = rows.withColumn("swing_team", other_team(F.col("side"))).join(as_it_lies(swing), ["match_id", "round_number", "swing_team"], "left")
    one = F.col("side") == TEAM_1
    self_kill = F.col("self_kill")
    own, opp = F.when(one, F.col("alive_1")).otherwise(F.col("alive_2")), F.when(one, F.col("alive_2")).otherwise(F.col("alive_1"))
    weight = F.when(self_kill, order_weight(own, opp)).otherwise(order_weight(opp, own))
    econ = econ_factor(F.col("killer_loadout"), F.col("victim_loadout"), self_kill)
    clock = [F.col(c) for c in ("t", "planted", "plant_time", "exploded", "defused", "defuse_time")]
    death = F.col("w") * F.when(self_kill, 1.0).otherwise(F.coalesce("traded_factor", F.lit(1.0)))
    given = lambda c: F.when(self_kill, 0.0).otherwise(c)
    return (
        rows.withColumn("w", weight)
        .withColumn("econ", econ)
        .withColumn("sw", F.coalesce("swing", F.lit(1.0)))
        .select(
            "match_id", "round_id", "round_number", "kill_id", "seq", "killer", "victim", "side", "self_kill", "alive_1", "alive_2", "t",
            given(F.col("w")).alias("kill_bonus"), given(F.col("w") * F.col("econ")).alias("kill_econ"), given(F.col("w") * time_factor(*clock)).alias("kill_time"), given(F.col("w") * F.col("sw")).alias("kill_swing"),
            death.alias("death_bonus"), (death * F.when(self_kill, self_kill_econ(F.col("econ"))).otherwise(F.col("econ"))).alias("death_econ"),
            (death * time_factor(*clock, for_death=True)).alias("death_time"), (death * F.col("sw")).alias("death_swing"),
            combat_bonus(opp, self_kill).alias("combat_bonus"),
            (~self_kill & clutch_bucket(own, opp)).alias("killer_clutch"), (~self_kill & clutch_bucket(opp, own)).alias("victim_clutch"),
            (F.coalesce(F.col("planted") & (F.col("t") >= F.col("plant_time")), F.lit(False))).alias("post_plant"),
            (~self_kill & (tier_code(F.col("killer_loadout")) != tier_code(F.col("victim_loadout")))).alias("econ_mismatch"),
        )
    )


def whole(c: Column) -> Column:
    """The nearest whole number to ``c`` rounded to six decimals, so that sums in another order are equal; half to even.

    Decimals decide only beside a half: elsewhere, and on it, the double itself rounds to the same.
    """
    off = F.abs(c - F.floor(c) - 0.5)
    return F.when((off > 1e-4) | (off == 0), F.rint(c)).otherwise(F.bround(F.round(c, 6), 0)).cast("long")


def impact_scores(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, stats: DataFrame, kills: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """A row per round and player of ``stats``: kill_impact, death_impact, impact and the parts they break down into.

    ``kills`` (kill_factors) and ``found`` (trades) may be given as they were written: each is a stage of
    its own then, where one task would otherwise hold the sorts of all of them at once.
    """
    kills = kill_factors(feed, rounds, match_players, stats) if kills is None else kills
    when = lambda flag, c: F.sum(F.when(F.col(flag), F.col(c)).otherwise(0.0))
    keys = ["match_id", "round_id", "match_player_id"]
    made = kills.where("killer is not null").groupBy("match_id", "round_id", F.col("killer").alias("match_player_id")).agg(
        F.count("*").alias("k"), F.sum("combat_bonus").alias("acs"), F.sum("kill_econ").alias("ke"), F.sum("kill_time").alias("kt"), F.sum("kill_swing").alias("ks"),
        when("killer_clutch", "kill_bonus").alias("kc"), when("post_plant", "kill_time").alias("kp"), when("econ_mismatch", "kill_econ").alias("km"),
    )
    taken = kills.groupBy("match_id", "round_id", F.col("victim").alias("match_player_id")).agg(
        F.sum("death_econ").alias("de"), F.sum("death_time").alias("dt"), F.sum("death_swing").alias("ds"),
        when("victim_clutch", "death_bonus").alias("dc"), when("post_plant", "death_time").alias("dp"), when("econ_mismatch", "death_econ").alias("dm"),
    )
    found = trades(with_teams(feed, match_players)) if found is None else found
    given = found.groupBy("match_id", "round_id", F.col("trader").alias("match_player_id")).agg(F.count("*").alias("traded_teammate"))
    got = found.groupBy("match_id", "round_id", F.col("traded").alias("match_player_id")).agg(F.count("*").alias("traded_by_teammate"))
    rows = stats
    for more in (made, taken, given, got):
        rows = rows.join(as_it_lies(more), keys, "left")
    rows = rows.na.fill(0, [c for c in rows.columns if c not in keys])  # filled keys would have to be dealt again
    damage = whole((F.col("score") - F.col("acs") + F.when(F.col("k") > 1, 50 * F.col("k")).otherwise(0)) * F.lit(1.25))
    rows = rows.withColumn("damage", damage)
    kill, death = whole(F.col("damage") + (F.col("ke") + F.col("kt") + F.col("ks")) / 3), whole((F.col("de") + F.col("dt") + F.col("ds")) / 3)
    return rows.select(
        *keys, "round_number", "team", kill.alias("kill_impact"), death.alias("death_impact"), (kill - death).alias("impact"), "damage",
        whole(F.col("ke") - F.col("de")).alias("econ_impact"), whole(F.col("kt") - F.col("dt")).alias("time_impact"), whole(F.col("ks") - F.col("ds")).alias("swing_impact"),
        whole(F.col("km")).alias("econ_kill"), whole(F.col("dm")).alias("econ_death"), whole(F.col("kc")).alias("clutch_kill"), whole(F.col("dc")).alias("clutch_death"),
        whole(F.col("kp")).alias("post_plant_kill"), whole(F.col("dp")).alias("post_plant_death"),
        F.col("traded_teammate").cast("long").alias("traded_teammate"), F.col("traded_by_teammate").cast("long").alias("traded_by_teammate"),
    )


def trade_pairs(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_id, round_id, trader, traded, n): who traded for whom, as rows instead of nested maps."""
    found = trades(with_teams(feed, match_players))
    return found.groupBy("match_id", "round_id", "trader", "traded").agg(F.count("*").alias("n"))


def keep_impact(path: str, changed: DataFrame, feed: DataFrame, rounds: DataFrame, match_players: DataFrame, stats: DataFrame) -> None:
    """Bring an impact table up to date for the matches of ``changed`` (match_id), and for these alone: after an ingest, or as a stream's batches land.

    A match that isn't in the tables any more keeps its rows.
    """
    from ..sources.ingest import upsert_by_match

    ids = changed.select("match_id").distinct()
    only = lambda df: df.join(ids, "match_id", "left_semi")
    upsert_by_match(impact_scores(only(feed), only(rounds), only(match_players), only(stats)), path)
