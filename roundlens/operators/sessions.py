"""Sessions, streaks and gaps: per-player orderings of matches, and the map model on top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import r6
from .summaries import in_acts, popularity

GAP_HOURS, OVERLAP, GAP_MOST = 6, 3, 20


def player_sessions(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(player_id, match_id, session): a player's matches in order; a new session after GAP_HOURS or when fewer than OVERLAP players stayed.

    Matches without a time are left out. Rosters are arrays of a match's players
    and travel with its rows; the windows are one player's.
    """
    roster = match_players.groupBy("match_id").agg(F.array_sort(F.collect_set("player_id")).alias("roster"))
    rows = match_players.select("player_id", "match_id").join(matches.where("played_at is not null").select("match_id", "played_at"), "match_id").join(roster, "match_id")
    w = Window.partitionBy("player_id").orderBy("played_at", "match_id")
    last, before = F.lag("played_at").over(w), F.lag("roster").over(w)
    stays = (F.col("played_at") <= last + F.expr(f"interval {GAP_HOURS} hours")) & (F.size(F.array_intersect("roster", before)) >= OVERLAP)
    rows = rows.withColumn("opens", F.when(F.coalesce(stays, F.lit(False)), 0).otherwise(1))
    return rows.select("player_id", "match_id", "played_at", (F.sum("opens").over(w) - 1).alias("session"))


def session_summary(sessions: DataFrame, matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """Per player and session: matches, first and last start, players seen, the core present in all, and matches won and lost by the player's side (a tie is a loss)."""
    keys = ["player_id", "session"]
    seat = match_players.select("match_id", "player_id", "team")
    rows = sessions.join(seat, ["match_id", "player_id"]).join(matches.select("match_id", "team1_rounds_won", "team2_rounds_won"), "match_id")
    one = F.col("team") == "team-1"
    won = F.when(one, F.col("team1_rounds_won") > F.col("team2_rounds_won")).otherwise(F.col("team2_rounds_won") > F.col("team1_rounds_won"))
    base = rows.groupBy(*keys).agg(F.count("*").alias("matches"), F.min("played_at").alias("first_at"), F.max("played_at").alias("last_at"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"))
    seen = sessions.select(*keys, "match_id").join(seat.select("match_id", F.col("player_id").alias("other")), "match_id").groupBy(*keys, "other").agg(F.count("*").alias("n"))
    sets = seen.join(base.select(*keys, "matches"), keys).groupBy(*keys).agg(F.count("*").alias("roster"), F.count_if(F.col("n") == F.col("matches")).alias("core"))
    return base.join(sets, keys)


def act_bounds(acts: DataFrame) -> DataFrame:
    """(act_id, act_start, act_end) from starts alone."""
    return acts.select("act_id", "act_start", F.lead("act_start").over(Window.orderBy("act_start")).alias("act_end"))


def map_windows(pools: DataFrame) -> DataFrame:
    """(map_name, first_act, last_act): runs of consecutive acts with the map in the pool."""
    rows = pools.withColumn("island", F.col("act_id") - F.row_number().over(Window.partitionBy("map_name").orderBy("act_id")))
    return rows.groupBy("map_name", "island").agg(F.min("act_id").alias("first_act"), F.max("act_id").alias("last_act")).drop("island")


def absence_streaks(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(player_id, map_name, best, trailing): a player's longest run of matches without a map, and the run the history ends with.

    Positions of plays within the player's history and their differences; no row per match and map.
    """
    w = Window.partitionBy("player_id").orderBy("played_at", "match_id")
    rows = match_players.select("player_id", "match_id").join(matches.where("played_at is not null and map_name is not null").select("match_id", "played_at", "map_name"), "match_id")
    rows = rows.withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("player_id")))
    gap = F.col("at") - 1 - F.coalesce(F.lag("at").over(Window.partitionBy("player_id", "map_name").orderBy("at")), F.lit(0))
    each = rows.withColumn("gap", gap).groupBy("player_id", "map_name").agg(F.max("gap").alias("g"), (F.max("n") - F.max("at")).alias("trailing"))
    return each.select("player_id", "map_name", F.greatest("g", "trailing").cast("long").alias("best"), F.col("trailing").cast("long").alias("trailing"))


def repeat_gaps(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(gap, n): over all players, how many games lay between two plays of the same map."""
    w = Window.partitionBy("player_id").orderBy("played_at", "match_id")
    rows = match_players.select("player_id", "match_id").join(matches.where("played_at is not null").select("match_id", "played_at", "map_name"), "match_id").withColumn("at", F.row_number().over(w))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("player_id", "map_name").orderBy("at"))
    return rows.select(gap.cast("long").alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def adjacent_repeats(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    """(player_id, pairs, repeats): consecutive matches in sessions, and those on the same map."""
    rows = sessions.join(matches.select("match_id", "map_name"), "match_id")
    last = F.lag("map_name").over(Window.partitionBy("player_id", "session").orderBy("played_at", "match_id"))
    return rows.withColumn("last", last).where("last is not null").groupBy("player_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("last") == F.col("map_name")).alias("repeats"))


def repeats_by_shared(sessions: DataFrame, matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(shared, pairs, repeats): pairs of matches that follow each other in anyone's session, each once, by how many players of both teams stayed, and those on one map."""
    roster = match_players.groupBy("match_id").agg(F.collect_set("player_id").alias("roster"))
    w = Window.partitionBy("player_id", "session").orderBy("played_at", "match_id")
    pairs = sessions.withColumn("before", F.lag("match_id").over(w)).where("before is not null").select("before", "match_id").distinct()
    seen = matches.select("match_id", "map_name").join(roster, "match_id")
    both = pairs.join(seen, "match_id").join(seen.toDF("before", "map_before", "roster_before"), "before")
    rows = both.select(F.size(F.array_intersect("roster", "roster_before")).cast("long").alias("shared"), (F.col("map_name") == F.col("map_before")).alias("same"))
    return rows.groupBy("shared").agg(F.count("*").alias("pairs"), F.count_if("same").alias("repeats"))


def session_gaps(sessions: DataFrame, matches: DataFrame) -> DataFrame:
    """(gap, n): how many matches on a map came again within a session, over everyone's sessions."""
    at = F.row_number().over(Window.partitionBy("player_id", "session").orderBy("played_at", "match_id"))
    rows = sessions.join(matches.select("match_id", "map_name"), "match_id").withColumn("at", at)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("player_id", "session", "map_name").orderBy("at"))
    return rows.select(gap.cast("long").alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def last_maps(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(player_id, map_name): each player's most recent map."""
    rows = match_players.select("player_id", "match_id").join(matches.where("played_at is not null").select("match_id", "played_at", "map_name"), "match_id")
    return rows.groupBy("player_id").agg(F.max_by("map_name", F.struct("played_at", "match_id")).alias("map_name"))


def last_map_shares(matches: DataFrame, match_players: DataFrame) -> DataFrame:
    """(map_name, n, share) of players whose most recent map it is."""
    n = last_maps(matches, match_players).groupBy("map_name").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def recent_matches(matches: DataFrame, match_players: DataFrame, n: int = 30) -> DataFrame:
    """(player_id, match_id, place): each player's last ``n`` matches, those without a time first, placed from old to new."""
    w = Window.partitionBy("player_id").orderBy(F.col("played_at").desc_nulls_first(), F.desc("match_id"))
    rows = match_players.select("player_id", "match_id").join(matches.select("match_id", "played_at"), "match_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return rows.select("player_id", "match_id", (F.max("r").over(Window.partitionBy("player_id")) - F.col("r") + 1).cast("long").alias("place"))


def predict_maps(matches: DataFrame, match_players: DataFrame, acts: DataFrame, lobbies: DataFrame, lobby_size: int = 10) -> DataFrame:
    """(lobby_id, map_name, p): the next map of each of ``lobbies`` (lobby_id, player_id), from popularity in the latest act and its players' last maps.

    A map that two or more of the lobby's players played last is damped to 0.2
    and one that one did to 0.47; for each player of ``lobby_size`` who isn't
    named it is damped by how common a last map it is. Named players without a
    last map damp nothing. Shares are normalised over the maps.
    """
    start = acts.agg(F.max("act_start")).first()[0]
    pool = popularity(matches, F.lit(start).cast("timestamp_ntz"))
    pool = pool if not pool.isEmpty() else popularity(matches)
    common = last_map_shares(matches, match_players).select("map_name", F.col("share").alias("p_last"))
    members = lobbies.select("lobby_id", "player_id").distinct()
    known = members.join(last_maps(matches, match_players), "player_id").groupBy("lobby_id", "map_name").agg(F.count("*").alias("k"))
    sizes = members.groupBy("lobby_id").agg(F.greatest(lobby_size - F.count("player_id"), F.lit(0)).alias("unknown"))
    rows = sizes.crossJoin(pool.select("map_name", "share")).join(known, ["lobby_id", "map_name"], "left").join(common, "map_name", "left")
    damp = F.when(F.col("k") >= 2, 0.2).when(F.col("k") == 1, 0.47).otherwise(1.0)
    raw = F.col("share") * damp * F.pow(1 - F.coalesce("p_last", F.lit(0.0)) * 0.53, F.col("unknown"))
    rows = rows.withColumn("raw", raw)
    return rows.select("lobby_id", "map_name", r6(F.col("raw") / F.sum("raw").over(Window.partitionBy("lobby_id"))).alias("p"))


def hazard(matches: DataFrame, match_players: DataFrame, acts: DataFrame) -> DataFrame:
    """(gap, chosen, offered): over players' matches within an act, how often a map came that was last played ``gap`` games ago, of how often it could.

    Each match offers the act's whole pool; gaps beyond GAP_MOST are one, and maps not yet played in the act don't count.
    """
    rows = match_players.select("player_id", "match_id").join(in_acts(matches, acts).select("match_id", "act_id", "played_at", "map_name"), "match_id")
    w = Window.partitionBy("player_id", "act_id").orderBy("played_at", "match_id")
    rows = rows.withColumn("at", F.row_number().over(w)).select("player_id", "act_id", "at", "map_name")
    pool = in_acts(matches, acts).select("act_id", F.col("map_name").alias("offered")).distinct()
    seen = rows.join(pool, "act_id").withColumn("mine", F.when(F.col("map_name") == F.col("offered"), F.col("at")))
    before = F.max("mine").over(Window.partitionBy("player_id", "act_id", "offered").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumn("gap", F.least(F.col("at") - before, F.lit(GAP_MOST)).cast("long")).where("gap is not null")
    return seen.groupBy("gap").agg(F.count("mine").alias("chosen"), F.count("*").alias("offered"))
