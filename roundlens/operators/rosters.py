"""Sessions of a scope of players: which side was theirs, who stayed, and who was there.

A scope is a set of players, such as an owner and friends. Its matches are those
that any of them played, so the same match may be in another session of another scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import TEAM_1, TEAM_2, played, r6
from .sessions import GAP_HOURS, OVERLAP
from .summaries import marked_mvps, with_result


def friend_scopes(friendships: DataFrame) -> DataFrame:
    """(scope_id, player_id): each owner with all friends."""
    return friendships.select(F.col("owner_id").alias("scope_id"), F.explode(F.array("owner_id", "friend_id")).alias("player_id")).distinct()


def scoped_sessions(matches: DataFrame, match_players: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope_id, match_id, played_at, session) of all matches with a time that a player of the scope (scope_id, player_id) was in.

    In order of time; a new session after GAP_HOURS or when fewer than OVERLAP
    players of both teams stayed.
    """
    roster = match_players.groupBy("match_id").agg(F.array_sort(F.collect_set("player_id")).alias("roster"))
    mine = match_players.join(scopes, "player_id").select("scope_id", "match_id").distinct()
    rows = mine.join(matches.where("played_at is not null").select("match_id", "played_at"), "match_id").join(roster, "match_id")
    w = Window.partitionBy("scope_id").orderBy("played_at", "match_id")
    near = F.col("played_at") <= F.lag("played_at").over(w) + F.expr(f"interval {GAP_HOURS} hours")
    stays = near & (F.size(F.array_intersect("roster", F.lag("roster").over(w))) >= OVERLAP)
    rows = rows.withColumn("opens", F.when(F.coalesce(stays, F.lit(False)), 0).otherwise(1))
    return rows.select("scope_id", "match_id", "played_at", (F.sum("opens").over(w) - 1).alias("session"))


def session_sides(sessions: DataFrame, match_players: DataFrame) -> DataFrame:
    """``sessions`` with our_team: the side with more of the players who were in all matches of the session.

    Null where both sides have as many, which makes a match ambiguous, and in sessions of one match.
    """
    key = ["scope_id", "session"]
    size = sessions.groupBy(*key).agg(F.count("*").alias("n"))
    seats = sessions.join(size, key).join(match_players.select("match_id", "player_id", "team"), "match_id")
    stayed = seats.groupBy(*key, "n", "player_id").agg(F.count_distinct("match_id").alias("m")).where("m = n and n > 1").select(*key, "player_id")
    held = seats.join(stayed, [*key, "player_id"]).groupBy(*key, "match_id").agg(F.count_if(F.col("team") == TEAM_1).alias("one"), F.count_if(F.col("team") == TEAM_2).alias("two"))
    team = F.when(F.col("one") > F.col("two"), TEAM_1).when(F.col("two") > F.col("one"), TEAM_2)
    return sessions.join(size, key).join(held.select(*key, "match_id", team.alias("our_team")), [*key, "match_id"], "left")


def session_rosters(sides: DataFrame, matches: DataFrame, match_players: DataFrame, players: DataFrame) -> DataFrame:
    """Per session of session_sides: matches, wins and losses where the side is known (a tie is a loss), ambiguous matches, and its players.

    roster is everyone on our side, or on both where it isn't known; core those
    who were so in every match; names are the core's in order and then the others'.
    """
    key = ["scope_id", "session"]
    rows = sides.join(matches.select("match_id", "team1_rounds_won", "team2_rounds_won"), "match_id")
    won = F.when(F.col("our_team") == TEAM_1, F.col("team1_rounds_won") > F.col("team2_rounds_won")).when(F.col("our_team") == TEAM_2, F.col("team2_rounds_won") > F.col("team1_rounds_won"))
    base = rows.groupBy(*key).agg(
        F.max("n").alias("matches"), F.min("played_at").alias("started_at"), F.max("played_at").alias("ended_at"), F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"),
        F.count_if(F.col("our_team").isNull() & (F.col("n") > 1)).alias("ambiguous"),
    )
    seats = sides.join(match_players.select("match_id", "player_id", "team"), "match_id").where("our_team is null or our_team = team")
    seen = seats.groupBy(*key, "n", "player_id").agg(F.count_distinct("match_id").alias("m")).join(players.select("player_id", "display_name"), "player_id", "left")
    core = F.col("m") == F.col("n")
    names = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("display_name"))))
    people = seen.groupBy(*key).agg(F.count("*").alias("roster"), F.count_if(core).alias("core"), names(core).alias("_core"), names(~core).alias("_rest"))
    people = people.select(*key, "roster", "core", F.array_join(F.concat("_core", F.array_except("_rest", "_core")), ", ").alias("names"))
    return base.join(people, key)


def session_of_match(sessions: DataFrame, match_id: int) -> DataFrame:
    """(scope_id, session) of a match in each scope: the way from a session of one scope to that of another."""
    return sessions.where(F.col("match_id") == match_id).select("scope_id", "session")


def session_seats(sides: DataFrame, match_players: DataFrame) -> DataFrame:
    """(scope_id, session, match_id, match_player_id, player_id) of everyone on our side, or on both where it isn't known."""
    seats = sides.join(match_players.select("match_id", "match_player_id", "player_id", "team"), "match_id")
    return seats.where("our_team is null or our_team = team").select("scope_id", "session", "match_id", "match_player_id", "player_id")


def session_leaderboard(seats: DataFrame, sides: DataFrame, impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per scope, session and player over played rounds: rounds, mean impact, mean death part, mean impact with won rounds' kills only, rounds won and lost.

    A round is won or lost by our side (session_sides): where the side isn't known, or
    the round has no winner, it is neither and its kills count for nothing.
    """
    side = sides.select("scope_id", "session", "match_id", "our_team")
    rows = with_result(impact, rounds).where(played(F.col("outcome"))).join(seats, ["match_id", "match_player_id"]).join(side, ["scope_id", "session", "match_id"])
    won = F.col("winner") == F.col("our_team")
    own = F.when(won, F.col("kill_impact")).otherwise(0) - F.col("death_impact")
    return rows.groupBy("scope_id", "session", "player_id").agg(
        F.count("*").alias("rounds"), r6(F.avg("impact")).alias("avg_impact"), r6(F.avg("death_impact")).alias("avg_death"), r6(F.avg(own)).alias("avg_win_impact"), F.count_if(won).alias("rounds_won"), F.count_if(~won).alias("rounds_lost"),
    )


def session_mvps(seats: DataFrame, impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """(scope_id, session, player_id, mvps, best): played rounds in which a player was the best of everyone in the match, the lowest seat of equals; best of all rounds of the player."""
    rows = impact.join(rounds.where(played(F.col("outcome"))).select("match_id", "round_id"), ["match_id", "round_id"])
    return marked_mvps(rows).join(seats, ["match_id", "match_player_id"]).groupBy("scope_id", "session", "player_id").agg(F.count_if("mvp").alias("mvps"), F.max("impact").alias("best"))
