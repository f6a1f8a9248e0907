"""Queries on scoped sessions and map streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rosters as O
from ..operators import streaks, summaries
from .base import query
from .scoring import scores
from .sessions import SESSION_SQL
from .summaries import ACT_SQL, RESULT_SQL

SCOPE_SQL = (
    SESSION_SQL
    + """, o_scope AS (SELECT DISTINCT scope_id, player_id FROM (SELECT owner_id AS scope_id, unnest([owner_id, friend_id]) AS player_id FROM a_friends)),
o_mine AS (SELECT DISTINCT s.scope_id, p.match_id FROM o_scope s JOIN a_match_players p USING (player_id)),
o_rows AS (SELECT o.scope_id, m.match_id, m.played_at, r.roster, m.team1_rounds_won AS w1, m.team2_rounds_won AS w2 FROM o_mine o JOIN a_matches m USING (match_id) JOIN s_roster r USING (match_id) WHERE played_at IS NOT NULL),
o_open AS (SELECT *, CASE WHEN played_at <= lag(played_at) OVER w + INTERVAL 6 HOUR AND len(list_intersect(roster, lag(roster) OVER w)) >= 3 THEN 0 ELSE 1 END AS opens FROM o_rows WINDOW w AS (PARTITION BY scope_id ORDER BY played_at, match_id)),
o_ses AS (SELECT *, count(*) OVER (PARTITION BY scope_id, session) AS n FROM (SELECT *, (sum(opens) OVER (PARTITION BY scope_id ORDER BY played_at, match_id) - 1)::BIGINT AS session FROM o_open)),
o_stay AS (SELECT scope_id, session, player_id FROM o_ses JOIN a_match_players USING (match_id) WHERE n > 1 GROUP BY scope_id, session, player_id, n HAVING count(DISTINCT match_id) = n),
o_side AS (SELECT s.*, CASE WHEN h.one > h.two THEN 'team-1' WHEN h.two > h.one THEN 'team-2' END AS our_team FROM o_ses s LEFT JOIN (
    SELECT q.scope_id, q.session, q.match_id, count(*) FILTER (p.team = 'team-1') AS one, count(*) FILTER (p.team = 'team-2') AS two FROM o_ses q JOIN a_match_players p USING (match_id)
    JOIN o_stay t ON t.scope_id = q.scope_id AND t.session = q.session AND t.player_id = p.player_id GROUP BY ALL) h ON h.scope_id = s.scope_id AND h.session = s.session AND h.match_id = s.match_id)"""
)


def _sides(a):
    return O.session_sides(O.scoped_sessions(a.matches, a.match_players, O.friend_scopes(a.friendships)), a.match_players)


query("b13_friend_scopes", "SELECT DISTINCT scope_id, player_id FROM (SELECT owner_id AS scope_id, unnest([owner_id, friend_id]) AS player_id FROM a_friends)")(lambda a: O.friend_scopes(a.friendships))
query("h4_scoped_sessions", "SELECT scope_id, match_id, session FROM o_ses", SCOPE_SQL)(lambda a: O.scoped_sessions(a.matches, a.match_players, O.friend_scopes(a.friendships)).select("scope_id", "match_id", "session"))
query("h2_session_sides", "SELECT scope_id, session, match_id, our_team FROM o_side", SCOPE_SQL)(lambda a: _sides(a).select("scope_id", "session", "match_id", "our_team"))
query(
    "h3_session_rosters",
    """SELECT b.*, q.roster, q.core, q.names FROM (SELECT scope_id, session, max(n) AS matches, min(played_at) AS started_at, max(played_at) AS ended_at,
        count(*) FILTER (CASE our_team WHEN 'team-1' THEN w1 > w2 WHEN 'team-2' THEN w2 > w1 END) AS wins, count(*) FILTER (NOT CASE our_team WHEN 'team-1' THEN w1 > w2 WHEN 'team-2' THEN w2 > w1 END) AS losses,
        count(*) FILTER (our_team IS NULL AND n > 1) AS ambiguous FROM o_side GROUP BY ALL) b
    JOIN (SELECT scope_id, session, count(*) AS roster, count(*) FILTER (core) AS core, string_agg(display_name, ', ' ORDER BY NOT core, display_name) AS names FROM (
        SELECT s.scope_id, s.session, p.player_id, any_value(d.display_name) AS display_name, count(DISTINCT s.match_id) = max(s.n) AS core FROM o_side s JOIN a_match_players p USING (match_id) JOIN a_players d ON d.player_id = p.player_id
        WHERE our_team IS NULL OR our_team = p.team GROUP BY ALL) GROUP BY ALL) q USING (scope_id, session)""",
    SCOPE_SQL,
)(lambda a: O.session_rosters(_sides(a), a.matches, a.match_players, a.players))
STREAK_SQL = (
    ACT_SQL
    + """, y_pool AS (SELECT act_id, map_name FROM b_acts GROUP BY ALL HAVING count(*) >= 3),
y_win AS (SELECT map_name, min(act_id) AS first_act, max(act_id) AS last_act FROM (SELECT *, act_id - row_number() OVER (PARTITION BY map_name ORDER BY act_id) AS island FROM y_pool) GROUP BY map_name, island),
y_rows AS (SELECT p.player_id, w.map_name, w.first_act, w.last_act, m.map_name = w.map_name AS hit, row_number() OVER k AS ord, count(*) OVER (PARTITION BY p.player_id, w.map_name, w.first_act) AS n
    FROM a_match_players p JOIN a_matches m USING (match_id) JOIN y_win w ON TRUE JOIN a_acts s ON s.act_id = w.first_act JOIN a_acts e ON e.act_id = w.last_act
    WHERE m.played_at >= s.act_start AND (e.act_end IS NULL OR m.played_at < e.act_end) WINDOW k AS (PARTITION BY p.player_id, w.map_name, w.first_act ORDER BY m.played_at, m.match_id)),
y_gap AS (SELECT player_id, map_name, first_act, last_act, greatest(max(n) - coalesce(max(ord) FILTER (hit), 0), coalesce(max(g) FILTER (hit), 0)) AS best, max(n) - coalesce(max(ord) FILTER (hit), 0) AS trailing
    FROM (SELECT *, ord - 1 - coalesce(max(CASE WHEN hit THEN ord END) OVER (PARTITION BY player_id, map_name, first_act ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM y_rows) GROUP BY player_id, map_name, first_act, last_act)"""
)
query("h7_window_gaps", "SELECT * FROM y_gap", STREAK_SQL)(lambda a: streaks.window_gaps(a.matches, a.match_players, streaks.map_windows(summaries.act_pools(a.matches, a.acts)), a.acts))
query(
    "h7_map_streaks",
    """SELECT c.player_id, c.map_name, c.first_act AS current_from, c.trailing AS current_gap, r.first_act AS record_from, r.last_act AS record_to, r.best AS record_gap,
        r.last_act = l.latest AND r.best = r.trailing AND r.best > 0 AS record_ongoing, r.last_act = l.latest AND r.best = c.trailing AS record_is_current
    FROM (SELECT max(act_id) AS latest FROM a_acts) l JOIN y_gap c ON c.last_act = l.latest
    JOIN (SELECT *, row_number() OVER (PARTITION BY player_id, map_name ORDER BY best DESC, last_act) AS k FROM y_gap) r ON r.player_id = c.player_id AND r.map_name = c.map_name AND r.k = 1""",
    STREAK_SQL,
)(lambda a: streaks.map_streaks(a.matches, a.match_players, summaries.act_pools(a.matches, a.acts), a.acts))
query("h4_session_of_match", "SELECT scope_id, session FROM o_ses WHERE match_id = (SELECT max(match_id) FROM o_ses)", SCOPE_SQL)(lambda a: _session_of_last(a))


def _session_of_last(a):
    """Where the last match of any scope is found in each scope."""
    found = O.scoped_sessions(a.matches, a.match_players, O.friend_scopes(a.friendships))
    return O.session_of_match(found, found.agg(F.max("match_id")).first()[0] or 0)


SEAT_SQL = f"""{RESULT_SQL}, {SCOPE_SQL}, o_seat AS (SELECT s.scope_id, s.session, s.match_id, s.our_team, p.match_player_id, p.player_id FROM o_side s JOIN a_match_players p USING (match_id) WHERE our_team IS NULL OR our_team = p.team),
o_res AS (SELECT o.scope_id, o.session, o.player_id, o.our_team, r.* FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY impact DESC, match_player_id) AS k FROM p_res WHERE outcome IS NULL OR outcome NOT LIKE '%Surrendered Win') r JOIN o_seat o ON o.match_player_id = r.match_player_id)"""
query(
    "d14_session_leaderboard",
    """SELECT scope_id, session, player_id, count(*) AS rounds, round(avg(impact), 6) AS avg_impact, round(avg(death_impact), 6) AS avg_death, round(avg(CASE WHEN winner = our_team THEN kill_impact ELSE 0 END - death_impact), 6) AS avg_win_impact,
        count(*) FILTER (winner = our_team) AS rounds_won, count(*) FILTER (winner <> our_team) AS rounds_lost FROM o_res GROUP BY ALL""",
    SEAT_SQL,
)(lambda a: _leaderboard(a))
query("d20_session_mvps", "SELECT scope_id, session, player_id, count(*) FILTER (k = 1) AS mvps, max(impact) AS best FROM o_res GROUP BY scope_id, session, player_id", SEAT_SQL)(
    lambda a: O.session_mvps(O.session_seats(_sides(a), a.match_players), scores(a), a.rounds)
)


def _leaderboard(a):
    sides = _sides(a)
    return O.session_leaderboard(O.session_seats(sides, a.match_players), sides, scores(a), a.rounds)
