"""Queries through the session's table functions."""

from __future__ import annotations

from ..sources import surface
from .base import query
from .scoring import IMPACT_SQL, scores


def functions(a, *names):
    """The session with the functions whose tables are among ``names``, or with all: only tables that are asked for are derived."""
    names = names or ("matches", "match_players", "rounds", "stats", "players", "friendships", "impact")
    surface.register(a.spark, {n: scores(a) if n == "impact" else getattr(a, n) for n in names})
    return a.spark


query(
    "s_player_career",
    """SELECT p.match_id, played_at, map_name, p.team, count(*) AS rounds, round(avg(impact), 6) AS avg_impact, max(impact) AS best FROM a_match_players p JOIN a_matches m ON m.match_id = p.match_id
    JOIN i_impact i ON i.match_player_id = p.match_player_id WHERE p.player_id = 7 GROUP BY ALL""",
    IMPACT_SQL,
)(lambda a: functions(a, "matches", "match_players", "impact").sql("SELECT * FROM player_career(7)"))
query(
    "s_match_rounds",
    "SELECT w.round_id, w.outcome, s.match_player_id, s.team, s.kills, s.deaths, s.loadout, i.impact FROM a_rounds w JOIN a_stats s ON s.round_id = w.round_id LEFT JOIN i_impact i ON i.round_id = s.round_id AND i.match_player_id = s.match_player_id WHERE w.match_id = 12 AND w.round_number = 3",
    IMPACT_SQL,
)(lambda a: functions(a, "rounds", "stats", "impact").sql("SELECT * FROM match_rounds(12, 3)"))
query(
    "s_squad",
    """SELECT f.friend_id, display_name, count(DISTINCT a.match_id) AS matches, count(*) AS rounds, count(*) FILTER (w.winner = a.team) AS won FROM a_friends f JOIN a_match_players a ON a.player_id = f.owner_id
    JOIN a_match_players b ON b.match_id = a.match_id AND b.team = a.team AND b.player_id = f.friend_id JOIN a_win w ON w.match_id = a.match_id JOIN a_players d ON d.player_id = f.friend_id WHERE f.owner_id = 3 GROUP BY ALL""",
)(lambda a: functions(a, "match_players", "rounds", "players", "friendships").sql("SELECT * FROM squad(3)"))
query(
    "s_careers",
    "SELECT p.player_id, match_id, count(*) AS rounds, round(avg(impact), 6) AS avg_impact FROM (SELECT match_player_id, player_id FROM a_match_players) p JOIN i_impact i USING (match_player_id) GROUP BY p.player_id, match_id",
    IMPACT_SQL,
)(lambda a: functions(a, "matches", "match_players", "players", "impact").sql("SELECT p.player_id, c.match_id, c.rounds, c.avg_impact FROM arena_players p, LATERAL player_career(p.player_id) c"))
