"""Queries on who was standing, on diagrams, charts and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import r6
from ..operators import diagrams as D
from ..operators import replay as R
from ..operators import standing as S
from ..operators import summaries as P
from .base import query
from .replay import REPLAY_SQL, STATES
from .scoring import IMPACT_SQL, scores

FRAG_SQL = "f_sum AS (SELECT match_id, team, match_player_id, sum(kills) AS k FROM a_stats GROUP BY ALL), f_frag AS (SELECT match_id, team, min(match_player_id) FILTER (k = hi) AS top, min(match_player_id) FILTER (k = lo) AS bottom FROM (SELECT *, max(k) OVER w AS hi, min(k) OVER w AS lo FROM f_sum WINDOW w AS (PARTITION BY match_id, team)) GROUP BY ALL)"
query("e9_fraggers", "SELECT * FROM f_frag", FRAG_SQL)(lambda a: S.fraggers(a.stats))
query(
    "g4_standing",
    """SELECT match_id, mp AS match_player_id, sum(x)::BIGINT AS even_fight_kills, sum(c)::BIGINT AS outnumbered_kills, sum(t)::BIGINT AS kills_of_top, sum(b)::BIGINT AS deaths_to_bottom, sum(l)::BIGINT AS last_in_wipe FROM (
        SELECT match_id, killer AS mp, (fight AND own = opp AND own > 0)::INT AS x, (fight AND own < opp)::INT AS c, (fight AND victim = top)::INT AS t, 0 AS b, 0 AS l FROM v_rows UNION ALL
        SELECT match_id, victim, 0, 0, 0, (fight AND killer = bottom)::INT, (CASE WHEN vteam = 'team-1' THEN l1 ELSE l2 END = 0)::INT FROM v_rows) WHERE mp IS NOT NULL GROUP BY ALL""",
    REPLAY_SQL
    + f""", {FRAG_SQL}, v_rows AS (SELECT s.*, coalesce(killer <> victim AND kteam <> vteam, FALSE) AS fight, CASE WHEN kteam = 'team-1' THEN s1 ELSE s2 END AS own, CASE WHEN vteam = 'team-1' THEN s1 ELSE s2 END AS opp, t.top, b.bottom
    FROM r_set s JOIN a_rounds r USING (round_id) LEFT JOIN f_frag t ON t.match_id = s.match_id AND t.team = s.vteam LEFT JOIN f_frag b ON b.match_id = s.match_id AND b.team = s.kteam WHERE r.outcome IS NULL OR r.outcome NOT LIKE '%Surrendered Win')""",
)(lambda a: S.standing_counters(a.kill_events, a.rounds, a.match_players, a.stats))
query(
    "g4_clutch_resolvers",
    """SELECT c.match_id, c.round_id, p.match_player_id FROM (SELECT match_id, round_id, team, seq FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY own, seq) AS r FROM (
            SELECT s.match_id, s.round_id, winner AS team, seq, CASE WHEN winner = 'team-1' THEN l1 ELSE l2 END AS own, CASE WHEN winner = 'team-1' THEN l2 ELSE l1 END AS opp FROM r_set s JOIN a_win w USING (round_id) WHERE winner IS NOT NULL)
        WHERE own IN (1, 2) AND opp >= own) WHERE r = 1) c JOIN a_match_players p ON p.match_id = c.match_id AND p.team = c.team
    LEFT JOIN (SELECT round_id, victim, seq AS fell FROM r_set WHERE fd) d ON d.round_id = c.round_id AND d.victim = p.match_player_id WHERE fell IS NULL OR fell > c.seq""",
    REPLAY_SQL,
)(lambda a: S.clutch_resolvers(a.kill_events, a.rounds, a.match_players))
EDGES = """e_all AS (SELECT mp AS match_player_id, CASE WHEN team = 'team-1' THEN c1 ELSE c2 END AS own, CASE WHEN team = 'team-1' THEN c2 ELSE c1 END AS opp, sum(k)::BIGINT AS kills, sum(d)::BIGINT AS deaths FROM (
        SELECT killer AS mp, kteam AS team, c1, c2, 1 AS k, 0 AS d FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim UNION ALL SELECT victim, vteam, c1, c2, 0, 1 FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim) GROUP BY ALL),
e_delta AS (SELECT match_player_id, own, opp, kills - deaths AS delta FROM e_all WHERE kills <> deaths)"""
query("i3_state_deltas", "SELECT * FROM e_delta", f"{REPLAY_SQL}, {EDGES}")(lambda a: D.state_deltas(R.order_edges(a.kill_events, a.match_players)))
query(
    "e7_top_deltas",
    "SELECT match_player_id, gain, place, own, opp, delta FROM (SELECT *, delta > 0 AS gain, row_number() OVER (PARTITION BY match_player_id, delta > 0 ORDER BY abs(delta) DESC, own, opp) AS place FROM e_delta) WHERE place <= 5",
    f"{REPLAY_SQL}, {EDGES}",
)(lambda a: D.top_deltas(D.state_deltas(R.order_edges(a.kill_events, a.match_players))))
query(
    "f18_win_colours",
    """SELECT own, opp, win_rate, CASE WHEN win_rate IS NOT NULL THEN printf('#%02x%02x%02x', round_even(224 + (12 - 224) * win_rate, 0)::INT, round_even(85 + (163 - 85) * win_rate, 0)::INT, round_even(79 + (12 - 79) * win_rate, 0)::INT) END AS colour
    FROM (SELECT own, opp, round(sum(wins) / sum(total), 6) AS win_rate FROM (%s) GROUP BY ALL)""".replace("%s", STATES),
    REPLAY_SQL,
)(lambda a: R.diamond(R.state_wins(a.kill_events, a.rounds, a.match_players)).where("total > 0").select("own", "opp", "win_rate", D.win_colour(F.col("win_rate")).alias("colour")))
LAYOUT = """l_raw AS (SELECT own, opp, (own - opp) * 118 / 2 AS x0, (10 - own - opp) * 134.0::DOUBLE AS y0 FROM (SELECT unnest(range(0, 6)) AS own), (SELECT unnest(range(0, 6)) AS opp) WHERE own > 0 OR opp > 0),
l_at AS (SELECT own, opp, x0 - min(x0) OVER () + 58 AS x, y0 - min(y0) OVER () + 58 AS y, max(x0) OVER () - min(x0) OVER () + 116 AS width, max(y0) OVER () - min(y0) OVER () + 116 AS height FROM l_raw)"""
query(
    "f19_layout",
    f"SELECT l.own, l.opp, l.x, l.y, l.width, l.height, coalesce(s.total, 0)::BIGINT AS total, round(s.wins / s.total, 6) AS win_rate FROM l_at l LEFT JOIN (SELECT own, opp, sum(wins) AS wins, sum(total) AS total FROM ({STATES}) GROUP BY ALL) s ON s.own = l.own AND s.opp = l.opp",
    REPLAY_SQL + ", " + LAYOUT,
)(lambda a: _placed(a))


def _placed(a):
    """The layout's places with what was counted in each state."""
    counted = R.diamond(R.state_wins(a.kill_events, a.rounds, a.match_players)).select("own", "opp", "total", "win_rate")
    return D.diamond_layout(a.spark, D.KILL_ORDER, 0).join(counted, ["own", "opp"], "left").select("own", "opp", "x", "y", "width", "height", F.coalesce("total", F.lit(0)).alias("total"), "win_rate")


def _lines(a):
    """The layout's edges with the eliminations and deaths that went along them."""
    went = R.order_edges(a.kill_events, a.match_players).groupBy("own", "opp").agg(F.sum("kills").alias("kill"), F.sum("deaths").alias("death"))
    went = went.select("own", "opp", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("kill", "death")])).alias("e")).select("own", "opp", "e.*")
    lines = D.edge_lines(D.diamond_layout(a.spark, D.KILL_ORDER, 0), 26.0).join(went, ["own", "opp", "kind"], "left")
    return lines.select("own", "opp", "kind", *[r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")], "mid_x", "mid_y", F.coalesce("n", F.lit(0)).alias("n"))


query(
    "f19_edges",
    """SELECT own, opp, kind, round(x + dx / sqrt(dx * dx + dy * dy) * 26, 6) AS x1, round(y + dy / sqrt(dx * dx + dy * dy) * 26, 6) AS y1, round(x + dx - dx / sqrt(dx * dx + dy * dy) * 26, 6) AS x2, round(y + dy - dy / sqrt(dx * dx + dy * dy) * 26, 6) AS y2,
        x + dx / 2 AS mid_x, y + dy / 2 AS mid_y, n FROM (SELECT a.own, a.opp, CASE WHEN b.opp = a.opp - 1 THEN 'kill' ELSE 'death' END AS kind, a.x, a.y, b.x - a.x AS dx, b.y - a.y AS dy, coalesce(CASE WHEN b.opp = a.opp - 1 THEN e.k ELSE e.d END, 0)::BIGINT AS n
        FROM l_at a JOIN l_at b ON (b.own = a.own AND b.opp = a.opp - 1) OR (b.own = a.own - 1 AND b.opp = a.opp) LEFT JOIN l_went e ON e.own = a.own AND e.opp = a.opp WHERE a.own > 0 AND a.opp > 0)""",
    REPLAY_SQL
    + ", "
    + LAYOUT
    + """, l_went AS (SELECT own, opp, sum(k) AS k, sum(d) AS d FROM (
        SELECT CASE WHEN kteam = 'team-1' THEN c1 ELSE c2 END AS own, CASE WHEN kteam = 'team-1' THEN c2 ELSE c1 END AS opp, 1 AS k, 0 AS d FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim AND killer IS NOT NULL
        UNION ALL SELECT CASE WHEN vteam = 'team-1' THEN c1 ELSE c2 END, CASE WHEN vteam = 'team-1' THEN c2 ELSE c1 END, 0, 1 FROM r_count WHERE c1 >= 1 AND c2 >= 1 AND killer <> victim) GROUP BY ALL)""",
)(lambda a: _lines(a))
query(
    "i6_player_series",
    """SELECT p.match_id, p.match_player_id, string_agg(coalesce(i.impact::VARCHAR, '-'), ',' ORDER BY r.round_number) AS data FROM (SELECT DISTINCT match_id, match_player_id FROM i_impact) p JOIN (SELECT DISTINCT match_id, round_number FROM a_rounds) r USING (match_id)
    LEFT JOIN i_impact i ON i.match_player_id = p.match_player_id AND i.match_id = p.match_id AND i.round_number = r.round_number GROUP BY ALL""",
    IMPACT_SQL,
)(lambda a: D.player_series(scores(a), a.rounds).withColumn("data", F.array_join("data", ",", "-")))
query(
    "i6_team_series",
    """SELECT p.match_id, p.team, string_agg(coalesce(i.v, 0)::BIGINT::VARCHAR, ',' ORDER BY r.round_number) AS data FROM (SELECT DISTINCT match_id, team FROM i_impact) p JOIN (SELECT DISTINCT match_id, round_number FROM a_rounds) r USING (match_id)
    LEFT JOIN (SELECT match_id, team, round_number, sum(impact) AS v FROM i_impact GROUP BY ALL) i ON i.match_id = p.match_id AND i.team = p.team AND i.round_number = r.round_number GROUP BY ALL""",
    IMPACT_SQL,
)(lambda a: D.team_series(scores(a), a.rounds).withColumn("data", F.array_join("data", ",")))
query(
    "e6_maps_by_win_rate",
    """SELECT player_id, map_name, matches, win_rate, row_number() OVER (PARTITION BY player_id ORDER BY coalesce(win_rate, -1) DESC, matches DESC, map_name) AS place FROM (
        SELECT player_id, map_name, count(*) AS matches, round(count(*) FILTER (o > e) / nullif(count(*) FILTER (o <> e), 0), 6) AS win_rate FROM (
            SELECT p.player_id, m.map_name, CASE WHEN p.team = 'team-1' THEN team1_rounds_won ELSE team2_rounds_won END AS o, CASE WHEN p.team = 'team-1' THEN team2_rounds_won ELSE team1_rounds_won END AS e
            FROM a_match_players p JOIN a_matches m USING (match_id)) GROUP BY ALL)""",
)(lambda a: D.by_win_rate(P.grouped_wins(a.match_players, a.matches, "map_name"), "player_id", "map_name").select("player_id", "map_name", "matches", "win_rate", "place"))
query(
    "e12_even_rows",
    """SELECT player_id, agent_no, row, row_number() OVER (PARTITION BY player_id, row ORDER BY agent_no) AS place FROM (
        SELECT *, CASE WHEN pos < more * (base + 1) THEN pos // (base + 1) ELSE more + (pos - more * (base + 1)) // base END AS row FROM (
            SELECT *, n // rows AS base, n % rows AS more FROM (SELECT *, ceil(n / 4)::BIGINT AS rows FROM (
                SELECT player_id, agent_no, count(*) OVER (PARTITION BY player_id) AS n, row_number() OVER (PARTITION BY player_id ORDER BY agent_no) - 1 AS pos FROM (SELECT DISTINCT player_id, agent_no FROM a_match_players)))))""",
)(lambda a: D.even_rows(a.match_players.select("player_id", "agent_no").distinct(), "player_id", "agent_no"))
query("b14_exactly_one", "SELECT match_id, external_id FROM a_matches WHERE external_id = 'M1'")(lambda a: D.exactly_one(a.matches.where("external_id = 'M1'").select("match_id", "external_id"), "match M1"))
