"""Queries on sessions, streaks, the map model, credits and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economy, statistics, summaries
from ..operators import sessions as H
from .base import query
from .replay import REPLAY_SQL, fight_blocks
from .scoring import IMPACT_SQL, scores
from .summaries import ACT_SQL

SESSION_SQL = """s_roster AS (SELECT match_id, list(DISTINCT player_id) AS roster FROM a_match_players GROUP BY ALL),
s_rows AS (SELECT p.player_id, m.match_id, m.played_at, m.map_name, p.team, r.roster, m.team1_rounds_won, m.team2_rounds_won FROM a_match_players p JOIN a_matches m USING (match_id) JOIN s_roster r ON r.match_id = m.match_id WHERE played_at IS NOT NULL),
s_open AS (SELECT *, CASE WHEN played_at <= lag(played_at) OVER w + INTERVAL 6 HOUR AND len(list_intersect(roster, lag(roster) OVER w)) >= 3 THEN 0 ELSE 1 END AS opens FROM s_rows WINDOW w AS (PARTITION BY player_id ORDER BY played_at, match_id)),
s_ses AS (SELECT *, (sum(opens) OVER (PARTITION BY player_id ORDER BY played_at, match_id) - 1)::BIGINT AS session FROM s_open),
h_at AS (SELECT p.player_id, m.match_id, m.played_at, m.map_name, row_number() OVER (PARTITION BY player_id ORDER BY played_at, m.match_id) AS ord, count(*) OVER (PARTITION BY player_id) AS n FROM a_match_players p JOIN a_matches m USING (match_id) WHERE played_at IS NOT NULL)"""
query("h1_sessions", "SELECT player_id, match_id, session FROM s_ses", SESSION_SQL)(lambda a: H.player_sessions(a.matches, a.match_players).select("player_id", "match_id", "session"))
query(
    "h2_session_summary",
    """SELECT b.*, roster, core FROM (SELECT player_id, session, count(*) AS matches, min(played_at) AS first_at, max(played_at) AS last_at,
        count(*) FILTER (CASE WHEN team = 'team-1' THEN team1_rounds_won > team2_rounds_won ELSE team2_rounds_won > team1_rounds_won END) AS wins,
        count(*) FILTER (NOT CASE WHEN team = 'team-1' THEN team1_rounds_won > team2_rounds_won ELSE team2_rounds_won > team1_rounds_won END) AS losses FROM s_ses GROUP BY ALL) b
    JOIN (SELECT player_id, session, count(*) AS roster, count(*) FILTER (n = m) AS core FROM (SELECT s.player_id, s.session, o.player_id AS other, count(*) AS n, max(c.m) AS m FROM s_ses s JOIN a_match_players o ON o.match_id = s.match_id
        JOIN (SELECT player_id, session, count(*) AS m FROM s_ses GROUP BY ALL) c ON c.player_id = s.player_id AND c.session = s.session GROUP BY ALL) GROUP BY ALL) r USING (player_id, session)""",
    SESSION_SQL,
)(lambda a: H.session_summary(H.player_sessions(a.matches, a.match_players), a.matches, a.match_players))
query("h5_map_windows", "SELECT map_name, min(act_id) AS first_act, max(act_id) AS last_act FROM (SELECT map_name, act_id, act_id - row_number() OVER (PARTITION BY map_name ORDER BY act_id) AS island FROM (SELECT act_id, map_name FROM b_acts GROUP BY ALL HAVING count(*) >= 3)) GROUP BY map_name, island", ACT_SQL)(
    lambda a: H.map_windows(summaries.act_pools(a.matches, a.acts))
)
query(
    "h6_absence_streaks",
    """SELECT player_id, map_name, greatest(max(gap), max(n) - max(ord)) AS best, max(n) - max(ord) AS trailing FROM (SELECT *, ord - 1 - coalesce(lag(ord) OVER (PARTITION BY player_id, map_name ORDER BY ord), 0) AS gap FROM h_at) GROUP BY player_id, map_name""",
    SESSION_SQL,
)(lambda a: H.absence_streaks(a.matches, a.match_players))
query("h8_repeat_gaps", "SELECT gap, count(*) AS n FROM (SELECT ord - lag(ord) OVER (PARTITION BY player_id, map_name ORDER BY ord) AS gap FROM h_at) WHERE gap IS NOT NULL GROUP BY ALL", SESSION_SQL)(lambda a: H.repeat_gaps(a.matches, a.match_players))
query("h9_adjacent_repeats", "SELECT player_id, count(*) AS pairs, count(*) FILTER (l = map_name) AS repeats FROM (SELECT *, lag(map_name) OVER (PARTITION BY player_id, session ORDER BY played_at, match_id) AS l FROM s_ses) WHERE l IS NOT NULL GROUP BY ALL", SESSION_SQL)(
    lambda a: H.adjacent_repeats(H.player_sessions(a.matches, a.match_players), a.matches)
)
query(
    "h9_repeats_by_shared",
    """SELECT len(list_intersect(a.roster, b.roster))::BIGINT AS shared, count(*) AS pairs, count(*) FILTER (m.map_name = n.map_name) AS repeats FROM (
        SELECT DISTINCT match_id, l FROM (SELECT match_id, lag(match_id) OVER (PARTITION BY player_id, session ORDER BY played_at, match_id) AS l FROM s_ses) WHERE l IS NOT NULL) p
    JOIN s_roster a ON a.match_id = p.match_id JOIN s_roster b ON b.match_id = p.l JOIN a_matches m ON m.match_id = p.match_id JOIN a_matches n ON n.match_id = p.l GROUP BY ALL""",
    SESSION_SQL,
)(lambda a: H.repeats_by_shared(H.player_sessions(a.matches, a.match_players), a.matches, a.match_players))
query(
    "h9_session_gaps",
    """SELECT gap, count(*) AS n FROM (SELECT k - lag(k) OVER (PARTITION BY player_id, session, map_name ORDER BY k) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY player_id, session ORDER BY played_at, match_id) AS k FROM s_ses)) WHERE gap IS NOT NULL GROUP BY ALL""",
    SESSION_SQL,
)(lambda a: H.session_gaps(H.player_sessions(a.matches, a.match_players), a.matches))
query("h11_act_bounds", "SELECT act_id, act_start, act_end FROM a_acts")(lambda a: H.act_bounds(a.acts))
query("e2_last_maps", "SELECT player_id, arg_max(map_name, ord) AS map_name FROM h_at GROUP BY ALL", SESSION_SQL)(lambda a: H.last_maps(a.matches, a.match_players))
LAST_SQL = SESSION_SQL + ", h_last AS (SELECT player_id, arg_max(map_name, ord) AS map_name FROM h_at GROUP BY ALL), h_share AS (SELECT map_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM h_last GROUP BY map_name)"
query("e1_last_map_shares", "SELECT * FROM h_share", LAST_SQL)(lambda a: H.last_map_shares(a.matches, a.match_players))
query(
    "e3_recent_matches",
    """SELECT player_id, match_id, max(r) OVER (PARTITION BY player_id) - r + 1 AS place FROM (SELECT p.player_id, m.match_id, row_number() OVER (PARTITION BY player_id ORDER BY played_at DESC NULLS FIRST, m.match_id DESC) AS r
    FROM a_match_players p JOIN a_matches m USING (match_id)) WHERE r <= 30""",
)(lambda a: H.recent_matches(a.matches, a.match_players))
POOL_SQL = (
    LAST_SQL
    + """, j_late AS (SELECT map_name, count(*) AS n FROM a_matches WHERE played_at >= (SELECT max(act_start) FROM a_acts) GROUP BY ALL HAVING count(*) >= 3), j_all AS (SELECT map_name, count(*) AS n FROM a_matches GROUP BY ALL HAVING count(*) >= 3),
    j_pool AS (SELECT map_name, round(n / sum(n) OVER (), 6) AS share FROM (SELECT * FROM j_late UNION ALL SELECT * FROM j_all WHERE NOT EXISTS (SELECT 1 FROM j_late)))"""
)


def _stack_maps(a):
    """Stacks of five players by number, without opponents."""
    stacks = H.last_maps(a.matches, a.match_players).where("map_name is not null").select(F.floor((F.col("player_id") - 1) / 5).cast("long").alias("lobby_id"), "player_id")
    return H.predict_maps(a.matches, a.match_players, a.acts, stacks, 5).withColumnRenamed("lobby_id", "team_key")


query(
    "j7_predict_maps",
    """SELECT team_key, map_name, round(raw / sum(raw) OVER (PARTITION BY team_key), 6) AS p FROM (SELECT s.team_key, m.map_name,
        m.share * CASE WHEN k >= 2 THEN 0.2 WHEN k = 1 THEN 0.47 ELSE 1.0 END * pow(1 - coalesce(h.share, 0) * 0.53, s.unknown) AS raw
        FROM (SELECT (player_id - 1) // 5 AS team_key, 5 - count(map_name) AS unknown FROM h_last GROUP BY ALL) s, j_pool m
        LEFT JOIN (SELECT (player_id - 1) // 5 AS team_key, map_name, count(*) AS k FROM h_last GROUP BY ALL) k ON k.team_key = s.team_key AND k.map_name = m.map_name LEFT JOIN h_share h ON h.map_name = m.map_name)""",
    POOL_SQL,
)(_stack_maps)
query(
    "j7_predict_lobbies",
    """SELECT lobby_id, map_name, round(raw / sum(raw) OVER (PARTITION BY lobby_id), 6) AS p FROM (SELECT s.lobby_id, m.map_name,
        m.share * CASE WHEN k >= 2 THEN 0.2 WHEN k = 1 THEN 0.47 ELSE 1.0 END * pow(1 - coalesce(h.share, 0) * 0.53, greatest(10 - s.n, 0)) AS raw
        FROM (SELECT lobby_id, count(DISTINCT player_id) AS n FROM j_lobby GROUP BY ALL) s CROSS JOIN j_pool m
        LEFT JOIN (SELECT lobby_id, map_name, count(*) AS k FROM (SELECT DISTINCT * FROM j_lobby) JOIN h_last USING (player_id) GROUP BY ALL) k ON k.lobby_id = s.lobby_id AND k.map_name = m.map_name LEFT JOIN h_share h ON h.map_name = m.map_name)""",
    POOL_SQL + ", j_lobby AS (SELECT 2 * match_id + CASE WHEN team = 'team-2' THEN 1 ELSE 0 END AS lobby_id, player_id FROM a_match_players)",
)(lambda a: H.predict_maps(a.matches, a.match_players, a.acts, a.match_players.select((2 * F.col("match_id") + F.when(F.col("team") == "team-2", 1).otherwise(0)).alias("lobby_id"), "player_id")))
HAZARD_SQL = (
    ACT_SQL
    + """, z_at AS (SELECT p.player_id, b.act_id, b.map_name, row_number() OVER (PARTITION BY player_id, act_id ORDER BY played_at, b.match_id) AS ord FROM a_match_players p JOIN b_acts b USING (match_id)),
z_all AS (SELECT z.*, o.map_name AS offered, CASE WHEN z.map_name = o.map_name THEN ord END AS mine FROM z_at z JOIN (SELECT DISTINCT act_id, map_name FROM b_acts) o USING (act_id)),
z_haz AS (SELECT gap, count(mine) AS chosen, count(*) AS offered FROM (SELECT mine, least(ord - max(mine) OVER (PARTITION BY player_id, act_id, offered ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20) AS gap FROM z_all) WHERE gap IS NOT NULL GROUP BY gap)"""
)
query("j10_hazard", "SELECT * FROM z_haz", HAZARD_SQL)(lambda a: H.hazard(a.matches, a.match_players, a.acts))
query(
    "j12_log_likelihood",
    """SELECT round(sum(chosen * ln(least(greatest(p0, 1e-9), 1 - 1e-9)) + (offered - chosen) * ln(1 - least(greatest(p0, 1e-9), 1 - 1e-9))), 6) AS ll_null,
        round(sum(chosen * ln(least(greatest(p1, 1e-9), 1 - 1e-9)) + (offered - chosen) * ln(1 - least(greatest(p1, 1e-9), 1 - 1e-9))), 6) AS ll_gap
    FROM (SELECT *, chosen / offered AS p1, sum(chosen) OVER () / sum(offered) OVER () AS p0 FROM z_haz)""",
    HAZARD_SQL,
)(lambda a: statistics.log_likelihood(H.hazard(a.matches, a.match_players, a.acts)))
query(
    "j17_spearman",
    """SELECT match_id, count(*) AS n, round(1 - 6 * sum((ra - rb) ** 2) / (count(*) * (count(*) ** 2 - 1)), 6) AS rho FROM (
        SELECT match_id, rank() OVER (PARTITION BY match_id ORDER BY a) + (count(*) OVER (PARTITION BY match_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY match_id ORDER BY b) + (count(*) OVER (PARTITION BY match_id, b) - 1) / 2 AS rb
        FROM (SELECT match_id, match_player_id, sum(impact) AS a, sum(damage) AS b FROM i_impact GROUP BY ALL)) GROUP BY match_id HAVING count(*) > 1""",
    IMPACT_SQL,
)(lambda a: statistics.spearman(scores(a).groupBy("match_id", "match_player_id").agg(F.sum("impact").alias("a"), F.sum("damage").alias("b")), "match_id", "a", "b"))
query("j16_differences", "SELECT count(*) AS n, round(avg(impact - damage), 6) AS mean, round(avg(abs(impact - damage)), 6) AS mean_abs, round(quantile_cont(abs(impact - damage), 0.5), 6) AS median_abs, max(abs(impact - damage)) AS max_abs FROM i_impact", IMPACT_SQL)(
    lambda a: statistics.differences(scores(a), "damage", "impact")
)
def _fifth(x: str) -> str:
    return f"((({x}) * ({x}) % 2147483647) * (({x}) * ({x}) % 2147483647) % 2147483647 * ({x}) % 2147483647)"


query(
    "j5_bootstrap",
    """SELECT own, opp, round(quantile_cont(p, 0.025), 6) AS low, round(quantile_cont(p, 0.975), 6) AS high, round(count(*) / 200, 6) AS defined FROM (
        SELECT draw, own, opp, sum(k * kills) / sum(k * (kills + deaths)) AS p FROM r_blocks JOIN b_weight USING (match_id) GROUP BY draw, own, opp HAVING sum(k * (kills + deaths)) > 0) GROUP BY own, opp""",
    REPLAY_SQL
    + f""", b_first AS (SELECT match_id, draw, (draw * 48271 + match_id % 2147483647 * 69621 + 12345) % 2147483647 AS x FROM (SELECT DISTINCT match_id FROM r_blocks), (SELECT unnest(range(0, 200)) AS draw)),
    b_second AS (SELECT match_id, draw, ({_fifth("x")} + draw * 16807 + 1) % 2147483647 AS x FROM b_first),
    b_weight AS MATERIALIZED (SELECT match_id, draw, len(list_filter({statistics.POISSON}, lambda t: t <= x))::BIGINT AS k FROM (SELECT match_id, draw, {_fifth("x")} AS x FROM b_second))""",
)(lambda a: statistics.bootstrap_rates(fight_blocks(a)))


def tracked_roster(a):
    """Players with a friendship, by either end."""
    return a.friendships.select(F.explode(F.array("owner_id", "friend_id")).alias("player_id")).distinct()


def _fight_ev(a):
    from .fights import fight_cells

    return fight_cells(a)


query("j5_fight_ev")(_fight_ev)
#: Credits over statistics and sides alone: the round before by lag, if it is the one before.
CREDIT_ROWS = """c_stats AS MATERIALIZED (
    SELECT s.*, p.agent_no, lag(round_number) OVER w AS orn, lag(deaths) OVER w AS od, lag(loadout) OVER w AS ol, lag(remaining) OVER w + 200 * lag(kills) OVER w AS held
    FROM a_stats s JOIN (SELECT match_player_id, agent_no FROM a_match_players) p USING (match_player_id) WINDOW w AS (PARTITION BY match_player_id ORDER BY round_number)
), c_sides AS MATERIALIZED (
    SELECT match_id, team, round_number, CASE WHEN winner = team THEN 3000 WHEN losses = 0 THEN 1900 WHEN losses = 1 THEN 2400 ELSE 2900 END
        + CASE WHEN planted AND ((round_number <= 12 AND team = 'team-1') OR (round_number BETWEEN 13 AND 24 AND team = 'team-2')) THEN 300 ELSE 0 END AS paid
    FROM (SELECT *, round_number - 1 - coalesce(max(CASE WHEN winner = team THEN round_number END) OVER (PARTITION BY match_id, team ORDER BY round_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS losses
        FROM a_win, (VALUES ('team-1'), ('team-2')) t(team))
), c_cash AS MATERIALIZED (
    SELECT s.*, held + paid AS cash FROM c_stats s JOIN c_sides x ON x.match_id = s.match_id AND x.team = s.team AND x.round_number = s.round_number - 1 WHERE orn = s.round_number - 1 AND s.round_number NOT IN (1, 13)
)"""
CREDIT_SQL = CREDIT_ROWS + """, c_credits AS MATERIALIZED (
    SELECT match_id, round_id, round_number, match_player_id, CASE WHEN od = 0 THEN greatest(0, greatest(0, cash - remaining) - 1650) ELSE 0 END::BIGINT AS sugar, greatest(0, remaining + loadout - cash - CASE WHEN od = 0 THEN ol ELSE 0 END)::BIGINT AS scavenger FROM c_cash
)"""
query("f16_credits", "SELECT match_id, round_number, match_player_id, sugar, scavenger FROM c_credits", CREDIT_SQL)(lambda a: economy.credits(a.stats, a.rounds, a.match_players))
query(
    "c14_credits_by_agent",
    """SELECT match_id, round_number, match_player_id, CASE WHEN od = 0 THEN greatest(0, greatest(0, cash - remaining) - (1000 + coalesce(utility, 650))) ELSE 0 END::BIGINT AS sugar,
        greatest(0, remaining + greatest(0, loadout - coalesce(free, 0)) - cash - CASE WHEN od = 0 THEN greatest(0, ol - coalesce(free, 0)) ELSE 0 END)::BIGINT AS scavenger FROM c_cash LEFT JOIN c_agents USING (agent_no)""",
    CREDIT_ROWS + ", c_agents AS (SELECT a AS agent_no, 400 + 50 * (a % 7) AS utility, 100 * (a % 3) AS free FROM (SELECT unnest(range(0, 29)) AS a) WHERE a % 5 <> 4)",
)(lambda a: economy.credits(a.stats, a.rounds, a.match_players, a.spark.range(29).where("id % 5 <> 4").select(F.col("id").alias("agent_no"), (400 + 50 * (F.col("id") % 7)).alias("utility"), (100 * (F.col("id") % 3)).alias("free"))))
