"""Queries on fight values per player, their checks, comparisons of impact, and models of map choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import played
from ..operators import models as M
from ..operators import replay, statistics, validation
from ..operators import sessions as H
from ..sources.arena import SEAT_ORDER
from ..sources.tables import as_it_lies
from .base import query
from .replay import REPLAY_SQL, replayed
from .scoring import IMPACT_SQL, scores
from .sessions import HAZARD_SQL, SESSION_SQL, tracked_roster
from .summaries import ACT_SQL

FIGHT_SQL = (
    REPLAY_SQL
    + """, x_acc AS (SELECT w.match_id, w.round_id, w.round_number, w.winner FROM a_win w JOIN r_diag d USING (round_id) WHERE d.reason IS NULL),
x_states AS (SELECT match_id, round_number, winner, 5 AS s1, 5 AS s2 FROM x_acc UNION ALL SELECT match_id, round_number, winner, z1, z2 FROM r_moves),
x_seen AS (SELECT match_id, team, CASE WHEN (team = 'team-1') = (round_number <= 12) THEN 'attack' ELSE 'defend' END AS side, CASE WHEN team = 'team-1' THEN s1 ELSE s2 END::BIGINT AS own, CASE WHEN team = 'team-1' THEN s2 ELSE s1 END::BIGINT AS opp,
    count(*) AS entries, count(*) FILTER (winner = team) AS wins FROM x_states, (VALUES ('team-1'), ('team-2')) t(team) GROUP BY ALL),
x_wins AS (SELECT p.player_id, s.match_id, s.side, s.own, s.opp, s.entries, s.wins FROM x_seen s JOIN a_match_players p ON p.match_id = s.match_id AND p.team = s.team),
x_roster AS (SELECT DISTINCT unnest([owner_id, friend_id]) AS player_id FROM a_friends),
x_fought AS (SELECT match_id, t.team, CASE WHEN (t.team = 'team-1') = (round_number <= 12) THEN 'attack' ELSE 'defend' END AS side, CASE WHEN t.team = 'team-1' THEN y1 ELSE y2 END AS own, CASE WHEN t.team = 'team-1' THEN y2 ELSE y1 END AS opp,
    CASE WHEN kteam = t.team THEN killer ELSE victim END AS actor, count(*) FILTER (kteam = t.team) AS k, count(*) FILTER (kteam <> t.team) AS d FROM r_moves, (VALUES ('team-1'), ('team-2')) t(team) WHERE kteam <> vteam GROUP BY ALL),
x_duels AS (SELECT p.player_id, f.match_id, f.side, f.own, f.opp,
    sum(CASE WHEN mine THEN k ELSE 0 END)::BIGINT AS player_kills, sum(CASE WHEN mine THEN d ELSE 0 END)::BIGINT AS player_deaths, sum(CASE WHEN NOT mine AND tr THEN k ELSE 0 END)::BIGINT AS tracked_kills, sum(CASE WHEN NOT mine AND tr THEN d ELSE 0 END)::BIGINT AS tracked_deaths,
    sum(CASE WHEN NOT mine THEN k ELSE 0 END)::BIGINT AS all_kills, sum(CASE WHEN NOT mine THEN d ELSE 0 END)::BIGINT AS all_deaths
    FROM (SELECT f.*, p.player_id, p.match_player_id = f.actor AS mine, a.player_id IN (SELECT player_id FROM x_roster) AS tr FROM x_fought f JOIN a_match_players p ON p.match_id = f.match_id AND p.team = f.team JOIN a_match_players a ON a.match_player_id = f.actor) f
    JOIN (SELECT DISTINCT player_id FROM a_match_players) p USING (player_id) GROUP BY ALL),
x_w AS (SELECT player_id, side, own, opp, sum(wins) / sum(entries) AS w, sum(entries)::BIGINT AS entries FROM x_wins GROUP BY player_id, side, own, opp),
x_grid AS (SELECT player_id, side, own, opp FROM (SELECT DISTINCT player_id FROM x_wins), (VALUES ('attack'), ('defend')) s(side), (SELECT unnest(range(0, 6)) AS own), (SELECT unnest(range(0, 6)) AS opp)),
x_rate AS (SELECT g.player_id, g.side, g.own, g.opp, CASE WHEN g.side = 'attack' AND g.opp = 0 THEN 1.0 WHEN g.side = 'defend' AND g.own = 0 THEN 0.0 ELSE w.w END AS w, CASE WHEN (g.side = 'attack' AND g.opp = 0) OR (g.side = 'defend' AND g.own = 0) THEN NULL ELSE w.entries END AS entries
    FROM x_grid g LEFT JOIN x_w w ON w.player_id = g.player_id AND w.side = g.side AND w.own = g.own AND w.opp = g.opp),
x_d AS (SELECT player_id, side, own, opp, sum(player_kills) AS yk, sum(player_deaths) AS yd, sum(tracked_kills) AS tk, sum(tracked_deaths) AS td, sum(all_kills) AS ak, sum(all_deaths) AS ad FROM x_duels GROUP BY player_id, side, own, opp),
x_cell AS (SELECT r.player_id, r.side, r.own, r.opp, r.w, u.w AS w_u, v.w AS w_d, coalesce(yk, 0) AS yk, coalesce(yd, 0) AS yd, coalesce(tk, 0) AS tk, coalesce(td, 0) AS td, coalesce(ak, 0) AS ak, coalesce(ad, 0) AS ad
    FROM x_rate r LEFT JOIN x_rate u ON u.player_id = r.player_id AND u.side = r.side AND u.own = r.own AND u.opp = r.opp - 1 LEFT JOIN x_rate v ON v.player_id = r.player_id AND v.side = r.side AND v.own = r.own - 1 AND v.opp = r.opp
    LEFT JOIN x_d d ON d.player_id = r.player_id AND d.side = r.side AND d.own = r.own AND d.opp = r.opp WHERE r.own > 0 AND r.opp > 0)"""
)


def _blocks(a):
    return replay.player_fight_blocks(a.kill_events, a.rounds, a.match_players, tracked_roster(a), replayed(a))


def fight_wins(a):
    """States that every player's side entered, written once."""
    return a.kept("fight_wins", lambda: _blocks(a)[0])


def fight_duels(a):
    """Duels of every player and teammates, written once."""
    return a.kept("fight_duels", lambda: _blocks(a)[1])


def blocks(a):
    """(wins, duels) of every player; queries that need one of them don't derive the other."""
    return fight_wins(a), fight_duels(a)


query("j1_player_wins", "SELECT player_id, match_id, side, own, opp, entries, wins FROM x_wins", FIGHT_SQL)(fight_wins)
query("j1_player_duels", "SELECT * FROM x_duels", FIGHT_SQL)(fight_duels)
query(
    "j7_fight_views",
    """SELECT player_id, pool, side, own, opp, round(p_player, 6) AS p_player, n_player, round(p_teammates, 6) AS p_teammates, n_teammates, round(w_u, 6) AS w_u, round(w_d, 6) AS w_d, round(lev, 6) AS leverage,
        round(CASE WHEN lev > 0 THEN (p_player - p_teammates) * lev END, 6) AS m, CASE WHEN lev IS NULL THEN 'NO_DATA' WHEN lev <= 0 THEN 'NON_POSITIVE_LEVERAGE' ELSE 'POSITIVE' END AS state
    FROM (SELECT *, CASE WHEN p_player IS NOT NULL AND p_teammates IS NOT NULL THEN w_u - w_d END AS lev FROM (
        SELECT player_id, pool, side, own, opp, yk / nullif(yk + yd, 0) AS p_player, (yk + yd)::BIGINT AS n_player, k / nullif(k + d, 0) AS p_teammates, (k + d)::BIGINT AS n_teammates, w_u, w_d
        FROM (SELECT *, 'tracked' AS pool, tk AS k, td AS d FROM x_cell UNION ALL SELECT *, 'all', ak, ad FROM x_cell)))""",
    FIGHT_SQL,
)(lambda a: replay.fight_points(*blocks(a)))


def _rates(a):
    return validation.win_rates(fight_wins(a))


query(
    "j18_monotonicity",
    """SELECT a.player_id, a.side, a.own, a.opp, 'own' AS kind, round(a.w, 6) AS w, round(b.w, 6) AS w_next FROM x_rate a JOIN x_rate b ON b.player_id = a.player_id AND b.side = a.side AND b.own = a.own + 1 AND b.opp = a.opp WHERE b.w < a.w
    UNION ALL SELECT a.player_id, a.side, a.own, a.opp, 'opp', round(a.w, 6), round(b.w, 6) FROM x_rate a JOIN x_rate b ON b.player_id = a.player_id AND b.side = a.side AND b.own = a.own AND b.opp = a.opp + 1 WHERE b.w > a.w""",
    FIGHT_SQL,
)(lambda a: validation.monotonicity(_rates(a)))
query("j18_boundaries", "SELECT player_id, side, own, opp, round(w, 6) AS w, coalesce(entries, 0) AS entries FROM x_rate WHERE (side = 'attack' AND own = 0 AND opp > 0) OR (side = 'defend' AND opp = 0 AND own > 0)", FIGHT_SQL)(lambda a: validation.boundaries(_rates(a)))
query(
    "j18_complements",
    """SELECT a.player_id, a.own, a.opp, round(a.w, 6) AS w_attack, round(d.w, 6) AS w_defend, round(abs(a.w - (1 - d.w)), 6) AS diff FROM x_rate a JOIN x_rate d ON d.player_id = a.player_id AND d.own = a.opp AND d.opp = a.own AND d.side = 'defend'
    WHERE a.side = 'attack' AND a.own > 0 AND a.opp > 0 AND round(abs(a.w - (1 - d.w)), 6) > 0.15""",
    FIGHT_SQL,
)(lambda a: validation.complements(_rates(a)))
query(
    "j18_closures",
    """SELECT *, abs(leverage) < 0.05 AS unstable FROM (SELECT player_id, side, own, opp, round(w_u - w_d, 6) AS leverage, round((w - w_d) / (w_u - w_d), 6) AS p_star, round((yk + ak) / (yk + ak + yd + ad), 6) AS p_team,
        round(abs((w - w_d) / (w_u - w_d) - (yk + ak) / (yk + ak + yd + ad)), 6) AS diff FROM x_cell WHERE w IS NOT NULL AND w_u - w_d <> 0 AND yk + ak + yd + ad > 0) WHERE abs(leverage) < 0.05 OR diff > 0.15""",
    FIGHT_SQL,
)(lambda a: validation.closures(_rates(a), fight_duels(a)))
query("j18_reconstruction", "SELECT player_id, side, own, opp, (yk + ak)::BIGINT AS kills, (yd + ad)::BIGINT AS deaths FROM x_d", FIGHT_SQL)(lambda a: validation.reconstruction(fight_duels(a)))


def fight_cells(a):
    """Cells of all players with their intervals, written once."""
    return a.kept("fight_ev", lambda: statistics.fight_ev(*blocks(a), a.match_players))


def validation_reports(a):
    from .replay import canonical

    return validation.report(*blocks(a), fight_cells(a), canonical(a), a.match_players)


def _reported(a):
    """What the reports say, read back from their JSON."""
    got = validation_reports(a).select(F.from_json("report", validation.REPORT).alias("r")).select("r.*")
    total = lambda name, value: F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + value(x))
    one = lambda flag: F.when(flag, 1).otherwise(0)
    return got.select(
        "player_id", "matches_considered", "accepted_rounds", total("excluded_rounds", lambda x: x.n).alias("excluded_rounds"), F.size("excluded_rounds").cast("long").alias("reasons"),
        F.size("cells").cast("long").alias("cells"), total("cells", lambda x: one(x.m > 0)).alias("positive"), total("cells", lambda x: one(x.leverage <= 0)).alias("no_leverage"), total("cells", lambda x: x.n_player).alias("fights"), total("cells", lambda x: x.n_teammates).alias("mates"),
        F.size("monotonicity").cast("long").alias("monotonicity"), total("boundaries", lambda x: x.entries).alias("boundary_entries"), F.size("complements").cast("long").alias("complements"), F.size("closures").cast("long").alias("closures"),
        total("reconstruction", lambda x: x.kills).alias("kills"), total("reconstruction", lambda x: x.deaths).alias("deaths"), F.col("thresholds.least_matches").alias("least_matches"), F.col("thresholds.closure_most").alias("closure_most"),
    )


def _n(sql: str) -> str:
    return f"(SELECT player_id, count(*) AS n FROM ({sql}) GROUP BY player_id)"


query(
    "a22_validation_report",
    f"""SELECT p.player_id, matches_considered, accepted_rounds, excluded_rounds, reasons, 100::BIGINT AS cells, c.positive, c.no_leverage, c.fights, c.mates, coalesce(mo.n, 0) AS monotonicity, b.n AS boundary_entries, coalesce(co.n, 0) AS complements, coalesce(cl.n, 0) AS closures,
        coalesce(rc.kills, 0) AS kills, coalesce(rc.deaths, 0) AS deaths, 5::BIGINT AS least_matches, 0.15::DOUBLE AS closure_most
    FROM (SELECT player_id, count(DISTINCT match_id) AS matches_considered, count(*) FILTER (reason IS NULL) AS accepted_rounds, count(*) FILTER (reason IS NOT NULL) AS excluded_rounds, count(DISTINCT reason) AS reasons
        FROM (SELECT DISTINCT player_id, match_id FROM a_match_players) JOIN r_diag USING (match_id) GROUP BY player_id) p
    JOIN (SELECT player_id, count(*) FILTER (m > 0) AS positive, count(*) FILTER (lev <= 0) AS no_leverage, sum(n_player)::BIGINT AS fights, sum(n_teammates)::BIGINT AS mates FROM (
        SELECT *, CASE WHEN lev > 0 THEN (p - q) * lev END AS m FROM (SELECT player_id, yk / nullif(yk + yd, 0) AS p, (yk + yd)::BIGINT AS n_player, k / nullif(k + d, 0) AS q, (k + d)::BIGINT AS n_teammates, CASE WHEN yk + yd > 0 AND k + d > 0 THEN w_u - w_d END AS lev
            FROM (SELECT *, tk AS k, td AS d FROM x_cell UNION ALL SELECT *, ak, ad FROM x_cell))) GROUP BY player_id) c USING (player_id)
    LEFT JOIN {_n("SELECT a.player_id FROM x_rate a JOIN x_rate b ON b.player_id = a.player_id AND b.side = a.side AND b.own = a.own + 1 AND b.opp = a.opp WHERE b.w < a.w UNION ALL SELECT a.player_id FROM x_rate a JOIN x_rate b ON b.player_id = a.player_id AND b.side = a.side AND b.own = a.own AND b.opp = a.opp + 1 WHERE b.w > a.w")} mo USING (player_id)
    LEFT JOIN (SELECT player_id, sum(coalesce(entries, 0))::BIGINT AS n FROM x_rate WHERE (side = 'attack' AND own = 0 AND opp > 0) OR (side = 'defend' AND opp = 0 AND own > 0) GROUP BY player_id) b USING (player_id)
    LEFT JOIN {_n("SELECT a.player_id FROM x_rate a JOIN x_rate d ON d.player_id = a.player_id AND d.own = a.opp AND d.opp = a.own AND d.side = 'defend' WHERE a.side = 'attack' AND a.own > 0 AND a.opp > 0 AND round(abs(a.w - (1 - d.w)), 6) > 0.15")} co USING (player_id)
    LEFT JOIN {_n("SELECT player_id, round(w_u - w_d, 6) AS l, round(abs((w - w_d) / (w_u - w_d) - (yk + ak) / (yk + ak + yd + ad)), 6) AS diff FROM x_cell WHERE w IS NOT NULL AND w_u - w_d <> 0 AND yk + ak + yd + ad > 0 AND (abs(round(w_u - w_d, 6)) < 0.05 OR round(abs((w - w_d) / (w_u - w_d) - (yk + ak) / (yk + ak + yd + ad)), 6) > 0.15)")} cl USING (player_id)
    LEFT JOIN (SELECT player_id, sum(yk + ak)::BIGINT AS kills, sum(yd + ad)::BIGINT AS deaths FROM x_d GROUP BY player_id) rc USING (player_id)""",
    FIGHT_SQL,
)(_reported)

# Two versions of impact, each a table of its own: the old one leaves surrendered rounds out, has no share of trades and counts time within damage; the new one has all rounds with an outcome.
VERSIONS = (
    IMPACT_SQL
    + """, v_old AS (SELECT i.match_id, i.round_id, i.match_player_id, impact - 7 * traded_teammate AS impact, damage + time_impact AS damage FROM i_impact i JOIN (SELECT round_id, outcome FROM a_win) w USING (round_id) WHERE outcome IS NULL OR outcome NOT LIKE '%Surrendered Win'),
v_new AS (SELECT i.match_id, i.round_id, i.match_player_id, impact, damage FROM i_impact i JOIN (SELECT round_id, outcome FROM a_win) w USING (round_id) WHERE outcome IS NOT NULL),
v_both AS (SELECT match_id, round_id, match_player_id, o.impact AS old_impact, n.impact AS new_impact, n.impact - o.impact AS delta, n.damage - o.damage AS damage FROM v_old o JOIN v_new n USING (match_id, round_id, match_player_id))"""
)


def _versions(a):
    """Both versions with what is compared, each written once."""
    rows = scores(a).join(as_it_lies(a.rounds.select("match_id", "round_id", "outcome")), ["match_id", "round_id"])
    old = rows.where(played(F.col("outcome"))).withColumn("impact", F.col("impact") - 7 * F.col("traded_teammate")).withColumn("damage", F.col("damage") + F.col("time_impact"))
    keep = [*SEAT_ORDER, "impact", "damage"]
    return a.by_match("impact_before", lambda: old.select(keep), SEAT_ORDER), a.by_match("impact_after", lambda: rows.where("outcome is not null").select(keep), SEAT_ORDER)


def _compared(a):
    return validation.compared(*_versions(a), ["impact", "damage"])


query("c18_compared", "SELECT match_id, round_id, match_player_id, old_impact, new_impact, delta AS delta_impact FROM v_both", VERSIONS)(lambda a: _compared(a).select("match_id", "round_id", "match_player_id", "old_impact", "new_impact", "delta_impact"))
query(
    "c18_coverage",
    "SELECT coalesce(o.match_id, n.match_id) AS match_id, count(*) FILTER (o.round_id IS NOT NULL AND n.round_id IS NOT NULL) AS both, count(*) FILTER (n.round_id IS NULL) AS retired, count(*) FILTER (o.round_id IS NULL) AS added FROM v_old o FULL JOIN v_new n ON o.round_id = n.round_id AND o.match_player_id = n.match_player_id GROUP BY ALL",
    VERSIONS,
)(lambda a: validation.coverage(*_versions(a)))
query("j16_movers", "SELECT * FROM (SELECT round_id, match_player_id, delta AS delta_impact, row_number() OVER (ORDER BY abs(delta) DESC, round_id, match_player_id) AS place FROM v_both) WHERE place <= 15", VERSIONS)(
    lambda a: validation.biggest_movers(_compared(a)).select("round_id", "match_player_id", "delta_impact", "place")
)
query("j16_by_player", "SELECT player_id, count(*) AS n, round(avg(delta), 6) AS mean FROM v_both JOIN (SELECT match_player_id, player_id FROM a_match_players) USING (match_player_id) GROUP BY player_id", VERSIONS)(
    lambda a: validation.moves_by_player(_compared(a), a.match_players)
)
query("j16_by_part", "SELECT 'impact' AS part, round(avg(delta), 6) AS mean FROM v_both UNION ALL SELECT 'damage', round(avg(damage), 6) FROM v_both", VERSIONS)(lambda a: validation.moves_by_part(_compared(a), ["impact", "damage"]))

query(
    "j11_map_propensity",
    """SELECT map_name, sum(n) FILTER (map_name = played)::BIGINT AS chosen, sum(n)::BIGINT AS offered, round(coalesce(sum(n) FILTER (map_name = played), 0) / sum(n), 6) AS rate FROM (
        SELECT o.map_name, r.map_name AS played, r.n FROM (SELECT act_id, b.map_name, count(*) AS n FROM b_acts b JOIN a_match_players USING (match_id) GROUP BY ALL) r JOIN (SELECT DISTINCT act_id, map_name FROM b_acts) o USING (act_id)) GROUP BY map_name""",
    ACT_SQL,
)(lambda a: M.map_propensity(a.matches, a.match_players, a.acts))
LIKELY = "sum(chosen * ln(least(greatest(p, 1e-9), 1 - 1e-9)) + (offered - chosen) * ln(1 - least(greatest(p, 1e-9), 1 - 1e-9)))"
query(
    "j13_models",
    f"""SELECT model, a, b, round(ll, 6) AS ll, round(2 * (ll - (SELECT ll FROM n_null)), 4) AS gain FROM (
        SELECT 'null' AS model, NULL::DOUBLE AS a, NULL::DOUBLE AS b, ll FROM n_null UNION ALL SELECT 'gap_1', NULL, NULL, ll FROM n_one UNION ALL SELECT 'recovery', a, b, ll FROM (SELECT * FROM n_grid ORDER BY ll DESC, a, b LIMIT 1) UNION ALL SELECT 'tail', a, NULL, ll FROM (SELECT * FROM n_tail ORDER BY ll DESC, a LIMIT 1))""",
    HAZARD_SQL
    + f""", n_null AS (SELECT {LIKELY} AS ll FROM (SELECT *, sum(chosen) OVER () / sum(offered) OVER () AS p FROM z_haz)),
    n_one AS (SELECT {LIKELY} AS ll FROM (SELECT *, sum(chosen) OVER (PARTITION BY gap = 1) / sum(offered) OVER (PARTITION BY gap = 1) AS p FROM z_haz)),
    n_grid AS (SELECT a, b, round({LIKELY}, 6) AS ll FROM (SELECT h.*, a, b, least(greatest(q.p - (q.p - a) * pow(b, greatest(gap - 1, 0)), 1e-6), 1 - 1e-6) AS p FROM z_haz h, (SELECT unnest(range(0, 151, 5)) / 1000 AS a), (SELECT unnest(range(10, 96, 5)) / 100 AS b),
        (SELECT coalesce(sum(chosen) FILTER (gap BETWEEN 3 AND 12) / sum(offered) FILTER (gap BETWEEN 3 AND 12), sum(chosen) / sum(offered)) AS p FROM z_haz) q) GROUP BY a, b),
    n_tail AS (SELECT a, round({LIKELY}, 6) AS ll FROM (SELECT *, sum(chosen) OVER w / sum(offered) OVER w AS p, count(*) FILTER (gap >= 2 AND gap < a) OVER (PARTITION BY a) AS mid, count(*) FILTER (gap >= a) OVER (PARTITION BY a) AS late
        FROM z_haz, (SELECT unnest(range(10, 21))::DOUBLE AS a) WINDOW w AS (PARTITION BY a, CASE WHEN gap = 1 THEN 0 WHEN gap < a THEN 1 ELSE 2 END)) WHERE mid > 0 AND late > 0 GROUP BY a)""",
)(lambda a: M.compare_models(H.hazard(a.matches, a.match_players, a.acts)))
query(
    "j14_lobby_test",
    """SELECT count(*) AS total, sum(hit)::BIGINT AS hits, round(sum(p), 6) AS expected, round(sum(p * (1 - p)), 6) AS variance, round((sum(hit) - sum(p)) / sqrt(sum(p * (1 - p))), 4) AS z FROM (
        SELECT match_id, sum(s.p) AS p, max((l = map_name)::INT) AS hit FROM (SELECT DISTINCT match_id, map_name, l FROM (SELECT match_id, map_name, lag(map_name) OVER (PARTITION BY player_id ORDER BY played_at, match_id) AS l FROM h_at) WHERE l IS NOT NULL) u
        JOIN (SELECT map_name AS m, count(*) / sum(count(*)) OVER () AS p FROM a_matches WHERE played_at IS NOT NULL GROUP BY ALL) s ON s.m = u.l GROUP BY match_id)""",
    SESSION_SQL,
)(lambda a: M.lobby_test(a.matches, a.match_players))
