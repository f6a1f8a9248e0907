"""The pages' questions as SQL table functions of a session: their arguments are filters that reach the scans.

Tables are in buckets by match, so a function of a match reads one bucket of each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "player_career(id BIGINT)": (
        "match_id BIGINT, played_at TIMESTAMP_NTZ, map_name STRING, team STRING, rounds BIGINT, avg_impact DOUBLE, best DOUBLE",
        """SELECT p.match_id, m.played_at, m.map_name, p.team, count(*), round(avg(i.impact), 6), max(i.impact)
        FROM arena_match_players p JOIN arena_matches m ON m.match_id = p.match_id JOIN arena_impact i ON i.match_id = p.match_id AND i.match_player_id = p.match_player_id
        WHERE p.player_id = player_career.id GROUP BY p.match_id, m.played_at, m.map_name, p.team""",
    ),
    "match_rounds(id BIGINT, r BIGINT)": (
        "round_id BIGINT, outcome STRING, match_player_id BIGINT, team STRING, kills BIGINT, deaths BIGINT, loadout BIGINT, impact DOUBLE",
        """SELECT w.round_id, w.outcome, s.match_player_id, s.team, s.kills, s.deaths, s.loadout, i.impact
        FROM arena_rounds w JOIN arena_stats s ON s.match_id = w.match_id AND s.round_id = w.round_id
        LEFT JOIN arena_impact i ON i.match_id = s.match_id AND i.round_id = s.round_id AND i.match_player_id = s.match_player_id
        WHERE w.match_id = match_rounds.id AND s.match_id = match_rounds.id AND w.round_number = match_rounds.r""",
    ),
    "squad(owner BIGINT)": (
        "friend_id BIGINT, display_name STRING, matches BIGINT, rounds BIGINT, won BIGINT",
        """SELECT f.friend_id, d.display_name, count(DISTINCT a.match_id), count(*), count_if(w.outcome LIKE CASE WHEN a.team = 'team-1' THEN 'Team A%' ELSE 'Team B%' END)
        FROM arena_friendships f JOIN arena_match_players a ON a.player_id = f.owner_id JOIN arena_match_players b ON b.match_id = a.match_id AND b.team = a.team AND b.player_id = f.friend_id
        JOIN arena_rounds w ON w.match_id = a.match_id JOIN arena_players d ON d.player_id = f.friend_id
        WHERE f.owner_id = squad.owner AND a.player_id = squad.owner GROUP BY f.friend_id, d.display_name""",
    ),
}


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Put ``tables`` (of matches, match_players, rounds, stats, impact, players, friendships) into the session as arena_ views, and those of FUNCTIONS whose tables are all there.

    An argument of null matches nothing; a function of a match, round or player that
    isn't there has no rows.
    """
    for name, table in tables.items():
        table.createOrReplaceTempView(f"arena_{name}")
    for head, (columns, body) in FUNCTIONS.items():
        if set(re.findall(r"\barena_(\w+)", body)) <= set(tables):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
