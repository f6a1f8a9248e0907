"""Queries on replays, diamonds and leverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from ..sources.arena import ROUND_ORDER
from .base import query
from .scoring import IMPACT_SQL

# Counts on the plain feed, on first deaths, and the validated replay, as SQL.
REPLAY_SQL = (
    IMPACT_SQL
    + """, r_count AS (
    SELECT * FROM (SELECT *, 5 - coalesce(sum((vteam = 'team-1')::INT) OVER w, 0)::BIGINT AS c1, 5 - coalesce(sum((vteam = 'team-2')::INT) OVER w, 0)::BIGINT AS c2 FROM i_kt
        WINDOW w AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE (c1 > 0 AND c2 > 0) OR seq = 1
), r_first AS (SELECT *, row_number() OVER (PARTITION BY round_id, victim ORDER BY seq) = 1 AS fd FROM i_kt),
r_set AS (
    SELECT * FROM (SELECT *, 5 - coalesce(sum((fd AND vteam = 'team-1')::INT) OVER w, 0)::BIGINT AS s1, 5 - coalesce(sum((fd AND vteam = 'team-2')::INT) OVER w, 0)::BIGINT AS s2,
        5 - sum((fd AND vteam = 'team-1')::INT) OVER u::BIGINT AS l1, 5 - sum((fd AND vteam = 'team-2')::INT) OVER u::BIGINT AS l2 FROM r_first
        WINDOW w AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WHERE (s1 > 0 AND s2 > 0) OR seq = 1
), r_why AS (
    SELECT w.match_id, w.round_id, w.round_number, w.winner, CASE WHEN contains(outcome, 'Elimination') THEN 'E' WHEN contains(outcome, 'Detonate') THEN 'D' WHEN contains(outcome, 'Defuse') THEN 'F' WHEN contains(outcome, 'Time') THEN 'T' END AS cause,
        CASE WHEN contains(outcome, 'Detonate') THEN plant_time + 45 WHEN contains(outcome, 'Defuse') THEN defuse_time END AS stop,
        CASE WHEN coalesce(outcome LIKE '%Surrendered Win', FALSE) THEN 'surrendered' WHEN winner IS NULL THEN 'unknown_winner' WHEN round_number > 24 THEN 'overtime_unknown_side'
            WHEN coalesce(q.n, 0) <> coalesce(q.d, 0) THEN 'equal_time_ambiguity' END AS why
    FROM a_win w LEFT JOIN (SELECT round_id, count(*) AS n, count(DISTINCT t) AS d FROM a_kills GROUP BY ALL) q USING (round_id)
), r_in AS (
    SELECT k.*, r.round_number, r.winner, r.cause, r.stop, r.stop IS NULL OR k.t < r.stop AS inn FROM i_kt k JOIN r_why r USING (round_id) WHERE r.why IS NULL
), r_live AS (
    SELECT *, inn AND (fin IS NULL OR seq <= fin) AS live FROM (
        SELECT *, min(CASE WHEN cause = 'E' AND inn AND (z1 = 0 OR z2 = 0) THEN seq END) OVER (PARTITION BY round_id) AS fin FROM (
            SELECT *, 5 - coalesce(sum((inn AND NOT dead AND vteam = 'team-1')::INT) OVER w, 0)::BIGINT AS y1, 5 - coalesce(sum((inn AND NOT dead AND vteam = 'team-2')::INT) OVER w, 0)::BIGINT AS y2,
                5 - sum((inn AND NOT dead AND vteam = 'team-1')::INT) OVER u::BIGINT AS z1, 5 - sum((inn AND NOT dead AND vteam = 'team-2')::INT) OVER u::BIGINT AS z2
            FROM (SELECT i.*, EXISTS (SELECT 1 FROM r_in j WHERE j.round_id = i.round_id AND j.victim = i.victim AND j.inn AND j.seq < i.seq) AS dead,
                EXISTS (SELECT 1 FROM r_in j WHERE j.round_id = i.round_id AND j.victim = i.killer AND j.inn AND j.seq < i.seq) AS kdead FROM r_in i)
            WINDOW w AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
), r_diag AS (
    SELECT r.match_id, r.round_id, coalesce(r.why, CASE WHEN bool_or(live AND (dead OR coalesce(kdead AND killer <> victim, FALSE))) THEN 'ambiguous_lifecycle' END) AS reason,
        count(*) FILTER (live) AS live, count(*) FILTER (live AND kteam <> vteam) AS duels, count(*) FILTER (NOT live AND ((fin IS NOT NULL AND seq > fin) OR t >= l.stop)) AS late
    FROM r_why r LEFT JOIN r_live l USING (round_id) GROUP BY r.match_id, r.round_id, r.why
), r_moves AS (SELECT l.* FROM r_live l JOIN r_diag d USING (round_id) WHERE d.reason IS NULL AND l.live),
r_blocks AS (
    SELECT match_id, side, CASE WHEN team = 'team-1' THEN y1 ELSE y2 END AS own, CASE WHEN team = 'team-1' THEN y2 ELSE y1 END AS opp, count(*) AS entries, count(*) FILTER (winner = team) AS wins,
        count(*) FILTER (kteam <> vteam AND kteam = team) AS kills, count(*) FILTER (kteam <> vteam AND vteam = team) AS deaths
    FROM (SELECT m.* EXCLUDE (side), s.side, CASE WHEN (s.side = 'attack') = (round_number <= 12) THEN 'team-1' ELSE 'team-2' END AS team FROM r_moves m, (VALUES ('attack'), ('defend')) s(side)) GROUP BY ALL
)"""
)
TEAMS = "(VALUES ('team-1'), ('team-2')) t(team)"
STATES = f"SELECT r.match_id, team, CASE WHEN team = 'team-1' THEN c1 ELSE c2 END AS own, CASE WHEN team = 'team-1' THEN c2 ELSE c1 END AS opp, count(*) FILTER (winner = team) AS wins, count(*) AS total FROM r_count r JOIN a_win w USING (round_id), {TEAMS} WHERE winner IS NOT NULL AND c1 >= 1 AND c2 >= 1 GROUP BY ALL"

query("g3_state_wins", STATES, REPLAY_SQL)(lambda a: R.state_wins(a.kill_events, a.rounds, a.match_players))
query("i1_diamond", f"SELECT g.own, g.opp, coalesce(sum(wins), 0)::BIGINT AS wins, coalesce(sum(total), 0)::BIGINT AS total, round(sum(wins) / sum(total), 6) AS win_rate FROM (SELECT v AS own, o AS opp FROM i_w) g LEFT JOIN ({STATES}) s USING (own, opp) GROUP BY ALL", REPLAY_SQL)(
    lambda a: R.diamond(R.state_wins(a.kill_events, a.rounds, a.match_players))
)
query(
    "g2_player_diagram",
    """SELECT p.match_player_id, CASE WHEN p.team = 'team-1' THEN c1 ELSE c2 END AS own, CASE WHEN p.team = 'team-1' THEN c2 ELSE c1 END AS opp, count(*) FILTER (winner = p.team) AS wins, count(*) AS total
    FROM r_count r JOIN a_win w USING (round_id) JOIN a_match_players p ON p.match_id = r.match_id LEFT JOIN (SELECT round_id, victim, min(seq) AS died FROM a_kills GROUP BY ALL) d ON d.round_id = r.round_id AND d.victim = p.match_player_id
    WHERE winner IS NOT NULL AND c1 >= 1 AND c2 >= 1 AND (died IS NULL OR died >= r.seq) GROUP BY ALL""",
    REPLAY_SQL,
)(lambda a: R.player_diagram(a.kill_events, a.rounds, a.match_players))
query(
    "i2_order_edges",
    """SELECT mp AS match_player_id, CASE WHEN team = 'team-1' THEN c1 ELSE c2 END AS own, CASE WHEN team = 'team-1' THEN c2 ELSE c1 END AS opp, sum(k)::BIGINT AS kills, sum(d)::BIGINT AS deaths FROM (
        SELECT killer AS mp, kteam AS team, c1, c2, 1 AS k, 0 AS d FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim UNION ALL SELECT victim, vteam, c1, c2, 0, 1 FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim) GROUP BY ALL""",
    REPLAY_SQL,
)(lambda a: R.order_edges(a.kill_events, a.match_players))
query("g4_set_replay", "SELECT round_id, kill_id, s1 AS alive_1, s2 AS alive_2, l1::BIGINT AS left_1, l2::BIGINT AS left_2, fd AS first_death FROM r_set", REPLAY_SQL)(
    lambda a: R.set_replay(a.kill_events, a.match_players).select("round_id", "kill_id", "alive_1", "alive_2", "left_1", "left_2", "first_death")
)
query(
    "g4_streaks",
    """SELECT p AS match_player_id, max(n)::BIGINT AS streak FROM (SELECT match_id, p, island, sum(k) AS n FROM (
        SELECT *, coalesce(sum(d) OVER (PARTITION BY match_id, p ORDER BY round_number, seq, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM (
            SELECT s.match_id, killer AS p, round_number, seq, 0 AS step, 1 AS k, 0 AS d FROM r_set s JOIN a_rounds USING (round_id) WHERE killer IS NOT NULL
            UNION ALL SELECT s.match_id, victim, round_number, seq, 1, 0, 1 FROM r_set s JOIN a_rounds USING (round_id))) GROUP BY ALL) GROUP BY ALL""",
    REPLAY_SQL,
)(lambda a: R.kill_streaks(a.kill_events, a.rounds, a.match_players))
query(
    "g4_clutches",
    """SELECT match_id, round_id, team, own, opp, seq FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY own, seq) AS r FROM (
        SELECT s.match_id, s.round_id, winner AS team, seq, CASE WHEN winner = 'team-1' THEN l1 ELSE l2 END AS own, CASE WHEN winner = 'team-1' THEN l2 ELSE l1 END AS opp FROM r_set s JOIN a_win w USING (round_id) WHERE winner IS NOT NULL)
    WHERE own IN (1, 2) AND opp >= own) WHERE r = 1""",
    REPLAY_SQL,
)(lambda a: R.clutches(a.kill_events, a.rounds, a.match_players))
query(
    "g4_first_deaths_in_losses",
    "SELECT mp AS match_player_id, count(*) AS n FROM (SELECT round_id, vteam, arg_min(victim, seq) AS mp FROM i_kt GROUP BY ALL) JOIN a_win USING (round_id) WHERE winner <> vteam GROUP BY ALL",
    REPLAY_SQL,
)(lambda a: R.first_deaths_in_losses(a.kill_events, a.rounds, a.match_players))
query("g5_canonical", "SELECT match_id, round_id, reason, CASE WHEN reason IS NULL THEN live + 1 END AS entries, CASE WHEN reason IS NULL THEN duels END AS duels, CASE WHEN reason IS NULL THEN late END AS post_decision FROM r_diag", REPLAY_SQL)(
    lambda a: canonical(a)
)


def replayed(a):
    """The canonical replay of all rounds with its moves, written once: diagnostics, blocks and all fight values read it."""
    return a.by_match("replayed", lambda: R.replayed_rounds(a.kill_events, a.rounds, a.match_players), ROUND_ORDER)


def canonical(a):
    """What became of each round in the canonical replay."""
    return R.round_diagnostics(replayed(a))


def fight_blocks(a):
    """The blocks of all matches, written once: leverage and bootstrap read them too."""
    return a.kept("fight_blocks", lambda: R.fight_blocks(a.kill_events, a.rounds, a.match_players, replayed(a)))


query("j1_fight_blocks", "SELECT * FROM r_blocks", REPLAY_SQL)(fight_blocks)
query(
    "j4_fight_leverage",
    """SELECT side, own, opp, round(w, 6) AS win_rate, round(kills / nullif(kills + deaths, 0), 6) AS kill_rate, round(up - down, 6) AS leverage,
        CASE WHEN up - down IS NULL OR coalesce(kills + deaths, 0) = 0 THEN 'NO_DATA' WHEN up - down <= 0 THEN 'NON_POSITIVE_LEVERAGE' ELSE 'OK' END AS status
    FROM (SELECT a.*, b.w AS up, c.w AS down FROM j_w a LEFT JOIN j_w b ON b.side = a.side AND b.own = a.own AND b.opp = a.opp - 1 LEFT JOIN j_w c ON c.side = a.side AND c.own = a.own - 1 AND c.opp = a.opp WHERE a.own >= 1 AND a.opp >= 1)""",
    REPLAY_SQL
    + """, j_w AS (SELECT g.side, g.own, g.opp, sum(kills) AS kills, sum(deaths) AS deaths, CASE WHEN g.opp = 0 AND g.side = 'attack' THEN 1.0 WHEN g.own = 0 AND g.side = 'defend' THEN 0.0 ELSE sum(wins) / sum(entries) END AS w
    FROM (SELECT o.own, p.opp, side FROM (SELECT unnest(range(0, 6)) AS own) o, (SELECT unnest(range(0, 6)) AS opp) p, (VALUES ('attack'), ('defend')) s(side)) g LEFT JOIN r_blocks b ON b.side = g.side AND b.own = g.own AND b.opp = g.opp GROUP BY g.side, g.own, g.opp)""",
)(lambda a: R.fight_leverage(fight_blocks(a)))
