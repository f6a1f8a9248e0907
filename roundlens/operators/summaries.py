"""Keyed aggregations: players, matches, leaderboards and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import econ_tier, match_won, played, r6, rate, winner
from ..sources.tables import as_it_lies
from .intervals import interval_join

POOL_LEAST = 3
#: Tiers of killer and victim that make a death an upset.
UPSETS = [("ECO", "FORCE"), ("ECO", "FULL_BUY"), ("SAVE", "FORCE"), ("SAVE", "FULL_BUY")]
ENTRY_SECONDS, LATE_SECONDS, MULTI_KILLS, SNIPER_LOADOUT = 20, 60, 3, 5100


def matches_per_name(match_players: DataFrame, players: DataFrame) -> DataFrame:
    """(display_name, matches): by name, not id; players without a match don't appear."""
    return match_players.join(players, "player_id").groupBy("display_name").agg(F.count("*").alias("matches"))


def kda(stats: DataFrame) -> DataFrame:
    """Kills, deaths and assists per match player."""
    return stats.groupBy("match_player_id").agg(*[F.sum(c).alias(c) for c in ("kills", "deaths", "assists")])


def kda_rollup(stats: DataFrame, match_players: DataFrame) -> DataFrame:
    """Kills, deaths and assists per player and match, and per player where match_id is null."""
    rows = kda(stats).join(match_players.select("match_player_id", "match_id", "player_id"), "match_player_id")
    return rows.rollup("player_id", "match_id").agg(*[F.sum(c).alias(c) for c in ("kills", "deaths", "assists")]).where("player_id is not null")


def acquaintances(match_players: DataFrame, least: int = 2) -> DataFrame:
    """(player_id, other_id, matches): players met in at least ``least`` different matches. Joined within a match, so pairs stay at 90 a match."""
    a = match_players.select("match_id", "player_id")
    both = a.join(a.withColumnRenamed("player_id", "other_id"), "match_id").where("player_id <> other_id")
    return both.groupBy("player_id", "other_id").agg(F.count_distinct("match_id").alias("matches")).where(F.col("matches") >= least)


def popularity(matches: DataFrame, since: Column | None = None) -> DataFrame:
    """(map_name, n, share) of maps played at least POOL_LEAST times; shares are of the maps that are left."""
    rows = matches if since is None else matches.where(F.col("played_at") >= since)
    n = rows.groupBy("map_name").agg(F.count("*").alias("n")).where(F.col("n") >= POOL_LEAST)
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def in_acts(matches: DataFrame, acts: DataFrame) -> DataFrame:
    """Matches with the act they were played in."""
    return interval_join(matches, acts.select("act_id", "act_start", "act_end"), "played_at", "act_start", "act_end").drop("act_start", "act_end")


def act_pools(matches: DataFrame, acts: DataFrame) -> DataFrame:
    """(act_id, map_name, n) of maps played at least POOL_LEAST times in an act."""
    return in_acts(matches, acts).where("map_name is not null").groupBy("act_id", "map_name").agg(F.count("*").alias("n")).where(F.col("n") >= POOL_LEAST)


def with_result(impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """Impact rows with the round's winner and win_impact: the kill part only if the own side won."""
    info = rounds.select("match_id", "round_id", winner(F.col("outcome")).alias("winner"), "outcome")
    won = F.coalesce(F.col("winner") == F.col("team"), F.lit(False))
    return impact.join(as_it_lies(info), ["match_id", "round_id"]).withColumn("won", won).withColumn("win_impact", F.when(won, F.col("kill_impact")).otherwise(0) - F.col("death_impact"))


PARTS = ["damage", "econ_impact", "time_impact", "swing_impact", "clutch_kill", "clutch_death", "traded_teammate", "traded_by_teammate"]


def match_summary(impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """Means over rounds and sums of the parts, per match player."""
    rows = with_result(impact, rounds)
    return rows.groupBy("match_id", "match_player_id", "team").agg(
        F.count("*").alias("rounds"), r6(F.avg("impact")).alias("avg_impact"), r6(F.avg("kill_impact")).alias("avg_kill"), r6(F.avg("death_impact")).alias("avg_death"),
        r6(F.avg("win_impact")).alias("round_win_impact"), *[F.sum(c).alias(c) for c in PARTS],
    )


def impact_by_round(impact: DataFrame) -> DataFrame:
    """(match_player_id, by_round): each player's impact as a map from round number, at most a match's rounds long."""
    return impact.groupBy("match_id", "match_player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("round_number", "impact")))).alias("by_round"))


def team_summary(impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """Total impact per team and its mean over all rounds of the match, with or without rows."""
    n = rounds.groupBy("match_id").agg(F.count("*").alias("n_rounds"))
    return impact.groupBy("match_id", "team").agg(F.sum("impact").alias("total_impact")).join(as_it_lies(n), "match_id").withColumn("avg_impact", r6(F.col("total_impact") / F.col("n_rounds")))


def profile(impact: DataFrame, match_players: DataFrame) -> DataFrame:
    """Per player: the mean over all rounds, and each part's mean over matches that have scores."""
    rows = impact.join(as_it_lies(match_players.select("match_id", "match_player_id", "player_id")), ["match_id", "match_player_id"])
    m = F.count_distinct("match_id")
    return rows.groupBy("player_id").agg(m.alias("matches_with_scores"), F.count("*").alias("rounds"), r6(F.avg("impact")).alias("avg_impact"), *[r6(F.sum(c) / m).alias(f"{c}_per_match") for c in PARTS])


def with_match_result(seats: DataFrame, matches: DataFrame) -> DataFrame:
    """Seats with the match's map, and whether their side won: null for a tie."""
    rows = seats.join(as_it_lies(matches.select("match_id", "map_name", "team1_rounds_won", "team2_rounds_won")), "match_id")
    one = F.col("team") == "team-1"
    own, other = F.when(one, F.col("team1_rounds_won")).otherwise(F.col("team2_rounds_won")), F.when(one, F.col("team2_rounds_won")).otherwise(F.col("team1_rounds_won"))
    return rows.withColumn("won", match_won(own, other))


def _by_key(seats: DataFrame, key: str, *more: Column) -> DataFrame:
    wins = F.count_if(F.col("won"))
    return seats.where(F.col(key).isNotNull()).groupBy("player_id", key).agg(F.count("*").alias("matches"), *more, wins.alias("wins"), r6(rate(wins, F.count("won"))).alias("win_rate"))


def grouped_profile(impact: DataFrame, match_players: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Per player and agent or map: the mean of the matches' means, and the win rate without ties; a null key is left out."""
    per_match = impact.groupBy("match_id", "match_player_id").agg(F.avg("impact").alias("m"))
    seats = match_players.select("match_id", "match_player_id", "player_id", "agent_no", "team").join(as_it_lies(per_match), ["match_id", "match_player_id"])
    return _by_key(with_match_result(seats, matches), key, r6(F.avg("m")).alias("avg_impact"))


def grouped_wins(match_players: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Per player and agent or map: matches, wins and the win rate without ties, which impact has no part in; a null key is left out."""
    return _by_key(with_match_result(match_players, matches), key)


def leaderboard(impact: DataFrame, rounds: DataFrame, match_players: DataFrame) -> DataFrame:
    """Per player over played rounds: means, and rounds won and lost; rounds without a winner count as neither."""
    rows = with_result(impact, rounds).where(played(F.col("outcome"))).join(as_it_lies(match_players.select("match_id", "match_player_id", "player_id")), ["match_id", "match_player_id"])
    lost = F.col("winner").isNotNull() & ~F.col("won")
    return rows.groupBy("player_id").agg(
        F.count("*").alias("rounds"), r6(F.avg("impact")).alias("avg_impact"), r6(F.avg("win_impact")).alias("avg_win_impact"), F.count_if("won").alias("rounds_won"), F.count_if(lost).alias("rounds_lost"),
    )


def main_agent(match_players: DataFrame) -> DataFrame:
    """(player_id, agent_no, n): the agent played most, the lowest of equals."""
    n = match_players.groupBy("player_id", "agent_no").agg(F.count("*").alias("n"))
    return n.groupBy("player_id").agg(F.max_by("agent_no", F.struct("n", -F.col("agent_no"))).alias("agent_no"), F.max("n").alias("n"))


def stat_counters(stats: DataFrame, *more: str) -> DataFrame:
    """Per match player (and ``more``, which it implies): rounds of many kills, kills on a small or a sniper's loadout, active rounds."""
    return stats.groupBy(*more, "match_player_id").agg(
        F.count_if(F.col("kills") >= MULTI_KILLS).alias("multi_kill_rounds"), F.sum(F.when(F.col("loadout") < 3250, F.col("kills")).otherwise(0)).alias("eco_kills"),
        F.sum(F.when(F.col("loadout") >= SNIPER_LOADOUT, F.col("kills")).otherwise(0)).alias("sniper_kills"), F.count_if((F.col("kills") > 0) | (F.col("assists") > 0)).alias("active_rounds"),
    )


def biggest_multi_kill(stats: DataFrame, match_players: DataFrame, players: DataFrame) -> DataFrame:
    """(match_id, kills, holders): the most kills in a round of each match, and who made them, tags off, sorted."""
    top = stats.groupBy("match_id").agg(F.max("kills").alias("kills"))
    rows = stats.join(top, ["match_id", "kills"]).where("kills > 0").join(match_players.select("match_id", "match_player_id", "player_id"), ["match_id", "match_player_id"]).join(players, "player_id")
    return rows.groupBy("match_id", "kills").agg(F.array_join(F.array_sort(F.collect_set(F.split_part("display_name", F.lit("#"), F.lit(1)))), ", ").alias("holders"))


def feed_counters(feed: DataFrame, rounds: DataFrame, *more: str) -> DataFrame:
    """Per killer (and ``more``, which it implies): early, late and post-plant kills in one pass; self-kills are left out."""
    rows = feed.where("killer <> victim").join(rounds.select("match_id", "round_id", "plant_time"), ["match_id", "round_id"])
    return rows.groupBy(*more, F.col("killer").alias("match_player_id")).agg(F.count_if(F.col("t") <= ENTRY_SECONDS).alias("entry_kills"), F.count_if(F.col("t") >= LATE_SECONDS).alias("late_kills"), F.count_if(F.col("t") >= F.col("plant_time")).alias("post_plant_kills"))


def upset_deaths(feed: DataFrame, stats: DataFrame) -> DataFrame:
    """(match_player_id, n): deaths on at least a force buy to a killer on less."""
    load = stats.select("match_id", "round_id", "match_player_id", "loadout")
    rows = feed.where("killer <> victim").join(load.select("match_id", "round_id", F.col("match_player_id").alias("killer"), F.col("loadout").alias("k")), ["match_id", "round_id", "killer"])
    rows = rows.join(load.select("match_id", "round_id", F.col("match_player_id").alias("victim"), F.col("loadout").alias("v")), ["match_id", "round_id", "victim"])
    pair = F.struct(econ_tier(F.col("k")).alias("k"), econ_tier(F.col("v")).alias("v"))
    return rows.where(pair.isin(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in UPSETS])).groupBy(F.col("victim").alias("match_player_id")).agg(F.count("*").alias("n"))


def spike_deaths(feed: DataFrame) -> DataFrame:
    """(match_player_id, n): deaths to the bomb or the surroundings."""
    return feed.where(F.col("weapon").isin("Environmental", "Bomb")).groupBy(F.col("victim").alias("match_player_id")).agg(F.count("*").alias("n"))


def ghost_rounds(stats: DataFrame) -> DataFrame:
    """(match_player_id, n): rounds with no kill, death or assist."""
    return stats.where("kills = 0 and deaths = 0 and assists = 0").groupBy("match_player_id").agg(F.count("*").alias("n"))


def marked_mvps(impact: DataFrame) -> DataFrame:
    """``impact`` with mvp: whether the player's impact was the round's highest, the lowest id of equals."""
    first = F.row_number().over(Window.partitionBy("match_id", "round_id").orderBy(F.desc("impact"), "match_player_id"))
    return impact.withColumn("mvp", first == 1)


def round_mvps(impact: DataFrame, rounds: DataFrame, *more: str) -> DataFrame:
    """(``more`` of match_id, match_player_id, mvps, best): played rounds in which a player's impact was highest, and the best of all played rounds of the player."""
    rows = impact.join(as_it_lies(rounds.where(played(F.col("outcome"))).select("match_id", "round_id")), ["match_id", "round_id"])
    return marked_mvps(rows).groupBy("match_id", "match_player_id").agg(F.count_if("mvp").alias("mvps"), F.max("impact").alias("best")).select(*more, "match_player_id", "mvps", "best")


def round_econ(stats: DataFrame) -> DataFrame:
    """(match_id, round_number, team, mean_loadout): whole part of the team's mean loadout."""
    return stats.groupBy("match_id", "round_number", "team").agg(F.expr("sum(loadout) div count(*)").alias("mean_loadout"))


def econ_samples(stats: DataFrame, rounds: DataFrame) -> DataFrame:
    """A row per round and side with a known winner: tiers, loadouts and whether the side won."""
    from ..functions.scoring import graph_tier

    e = round_econ(stats)
    own = e.select("match_id", "round_number", "team", F.col("mean_loadout").alias("own"))
    other = e.select("match_id", "round_number", F.when(F.col("team") == "team-1", "team-2").otherwise("team-1").alias("team"), F.col("mean_loadout").alias("enemy"))
    rows = own.join(other, ["match_id", "round_number", "team"]).join(rounds.select("match_id", "round_number", winner(F.col("outcome")).alias("winner")), ["match_id", "round_number"]).where("winner is not null")
    n = F.col("round_number")
    return rows.select("match_id", "round_number", "team", "own", "enemy", graph_tier(n, F.col("own")).alias("own_tier"), graph_tier(n, F.col("enemy")).alias("enemy_tier"), (F.col("winner") == F.col("team")).alias("won"))


def tier_matrix(samples: DataFrame) -> DataFrame:
    """The four cells of own against enemy tier, pistol rounds left out; cells without rounds have a null rate."""
    spark = samples.sparkSession
    cells = spark.createDataFrame([(a, b) for a in ("ECO", "FULL_BUY") for b in ("ECO", "FULL_BUY")], "own_tier string, enemy_tier string")
    sums = samples.where("own_tier <> 'PISTOL'").groupBy("own_tier", "enemy_tier").agg(F.count_if("won").alias("w"), F.count("*").alias("n"), F.avg(F.try_divide("own", F.col("own") + F.col("enemy"))).alias("s"))
    return F.broadcast(cells).join(sums, ["own_tier", "enemy_tier"], "left").select("own_tier", "enemy_tier", F.coalesce("w", F.lit(0)).alias("wins"), F.coalesce("n", F.lit(0)).alias("total"), r6(100 * F.try_divide("w", "n")).alias("win_pct"), r6(F.col("s")).alias("own_share"))


def pistols(samples: DataFrame) -> DataFrame:
    """(team, wins, losses) of pistol rounds."""
    return samples.where("own_tier = 'PISTOL'").groupBy("team").agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"))


def share_histogram(samples: DataFrame) -> DataFrame:
    """Win rate by the own share of both loadouts, in buckets of five points; the radius grows with a bucket's rounds."""
    share = F.try_divide("own", F.col("own") + F.col("enemy"))
    rows = samples.withColumn("bucket", F.least(F.floor(F.floor(share * 100) / 5), F.lit(19))).where("bucket is not null")
    sums = rows.groupBy("bucket").agg(F.count_if("won").alias("wins"), F.count("*").alias("total"))
    return sums.select("bucket", "wins", "total", r6(100 * F.col("wins") / F.col("total")).alias("win_pct"), r6(2 + 14 * F.col("total") / F.max("total").over(Window.partitionBy())).alias("radius"))


def round_log(feed: DataFrame, rounds: DataFrame) -> DataFrame:
    """All that happened in each round, in order: eliminations, plants and defuses."""
    nothing = F.lit(None).cast("long")
    kills = feed.select("match_id", "round_id", F.lit("kill").alias("kind"), "t", F.col("killer").alias("actor"), F.col("victim").alias("target"))
    plants = rounds.where("planted and plant_time is not null").select("match_id", "round_id", F.lit("plant"), "plant_time", nothing, nothing)
    defuses = rounds.where("defused and defuse_time is not null").select("match_id", "round_id", F.lit("defuse"), "defuse_time", nothing, nothing)
    rows = kills.unionAll(plants).unionAll(defuses)
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("match_id", "round_id").orderBy("t", "kind", F.col("actor").asc_nulls_first(), F.col("target").asc_nulls_first())))


def meters(impact: DataFrame) -> DataFrame:
    """Each player's impact as a share of the largest in the round, by size."""
    top = F.max(F.abs("impact")).over(Window.partitionBy("match_id", "round_id"))
    rows = impact.select("match_id", "round_id", "match_player_id", "impact", top.alias("top")).where("top is not null")
    # Rounded as whole numbers, half away from zero: a share may lie just between two sixth decimals.
    steps = F.expr("(2000000 * abs(impact) + top) div nullif(2 * top, 0)")
    return rows.select("match_id", "round_id", "match_player_id", (F.signum(F.col("impact")) * steps / 1e6).alias("meter"))


