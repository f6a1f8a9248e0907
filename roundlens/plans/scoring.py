"""Queries on scalar scoring, trades, swing and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.scoring import r6
from ..operators import impact as I
from ..sources.arena import FEED_ORDER, SEAT_ORDER
from .base import query

# The impact computation as SQL, in steps that later queries use too.
IMPACT_SQL = """
i_kt AS (
    SELECT k.*, a.team AS kteam, b.team AS vteam, k.killer IS NULL OR k.killer = k.victim AS self_kill, coalesce(a.team, b.team) AS side
    FROM a_kills k LEFT JOIN a_match_players a ON a.match_player_id = k.killer LEFT JOIN a_match_players b ON b.match_player_id = k.victim
), i_last AS (
    SELECT round_id, p, max(seq) AS last FROM (SELECT round_id, killer AS p, seq FROM a_kills UNION ALL SELECT round_id, victim, seq FROM a_kills) GROUP BY ALL
), i_alive AS (
    SELECT *, 5 - coalesce(sum(CASE WHEN hit = 'team-1' AND out THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS alive_1, 5 - coalesce(sum(CASE WHEN hit = 'team-2' AND out THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS alive_2
    FROM (SELECT k.*, CASE WHEN self_kill THEN side WHEN side = 'team-1' THEN 'team-2' ELSE 'team-1' END AS hit, l.last = k.seq AS out FROM i_kt k LEFT JOIN i_last l ON l.round_id = k.round_id AND l.p = k.victim)
    WINDOW w AS (PARTITION BY round_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), i_trades AS (
    SELECT d1.round_id, d1.kill_id, d1.victim AS traded, arg_min(d2.killer, d2.seq) AS trader FROM i_kt d1 JOIN i_kt d2 ON d1.round_id = d2.round_id AND d2.victim = d1.killer
    WHERE d1.killer <> d1.victim AND d1.kteam <> d1.vteam AND d2.killer <> d2.victim AND d2.kteam = d1.vteam AND d2.t - d1.t BETWEEN 0 AND 10 GROUP BY ALL
), i_sides AS (
    SELECT *, round_number - 1 - coalesce(max(CASE WHEN winner = team THEN round_number END) OVER (PARTITION BY match_id, team ORDER BY round_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS losses
    FROM a_win, (VALUES ('team-1'), ('team-2')) t(team)
), i_money AS (
    SELECT s.*, x.losses, s.remaining + 200 * s.kills + CASE WHEN x.planted AND ((s.round_number <= 12 AND s.team = 'team-1') OR (s.round_number BETWEEN 13 AND 24 AND s.team = 'team-2')) THEN 300 ELSE 0 END AS money
    FROM a_stats s JOIN i_sides x USING (match_id, round_number, team)
), i_counts AS (
    SELECT match_id, round_number, team, count(*) FILTER (lost < 4200) AS cant, count(*) FILTER (lost >= 4200 AND lost < 7100) AS can, count(*) FILTER (lost >= 7100) AS dbl,
        count(*) FILTER (money + 3000 >= 4200 AND money + 3000 < 7100) AS win, count(*) FILTER (money + 3000 >= 7100) AS wdbl, count(*) FILTER (deaths > 0) AS need,
        count(*) FILTER (loadout >= 4200) AS bought, count(*) FILTER (loadout < 4200) AS short
    FROM (SELECT *, money + CASE losses WHEN 0 THEN 1900 WHEN 1 THEN 2400 ELSE 2900 END AS lost FROM i_money) GROUP BY ALL
), i_risk AS (
    SELECT *, CASE WHEN round_number IN (1, 13) THEN 1.5::DOUBLE WHEN round_number IN (12, 24) OR round_number > 24 THEN 1.0::DOUBLE
            WHEN can + 2 * dbl >= 5 THEN round_even(0.7::DOUBLE - round_even((can + 2 * dbl) * 0.05::DOUBLE, 2) + bought * sf, 1)
            WHEN round_number IN (2, 14) THEN round_even(1 + cant * 0.15::DOUBLE + (need - can) * 0.1::DOUBLE, 2)
            WHEN can + dbl < 5 THEN round_even(1 + (0.67::DOUBLE * (bought * sf) + cant * sf) + (need - (win + 2 * wdbl)) * sf, 2) ELSE 1.0::DOUBLE END AS risk
    FROM (SELECT *, round_even((bought + cant - dbl + 3) * 0.01::DOUBLE, 2) AS sf FROM i_counts)
), i_swing AS (
    SELECT match_id, round_number, team, risk, realised, CASE WHEN risk = 1 OR realised = 1 OR (risk > 1) <> (realised > 1) THEN 1.0 WHEN abs(realised - 1) > abs(risk - 1) THEN realised ELSE risk END AS swing
    FROM (SELECT r.*, CASE WHEN r.round_number IN (12, 24) OR r.round_number > 24 OR n.short IS NULL THEN 1.0::DOUBLE ELSE round_even(0.5::DOUBLE + 0.2::DOUBLE * n.short, 2) END AS realised
        FROM i_risk r LEFT JOIN i_counts n ON n.match_id = r.match_id AND n.team = r.team AND n.round_number = r.round_number + 1)
), i_tf AS (
    SELECT k.kill_id, min(d.t - k.t) / 10 AS tf FROM i_kt k JOIN a_kills d ON d.round_id = k.round_id AND d.victim = k.killer WHERE NOT k.self_kill AND d.t - k.t BETWEEN 0 AND 10 GROUP BY ALL
), i_w(v, o, w) AS (
    SELECT v, o, [[250, 130, 70, 50, 40], [190, 200, 140, 80, 50], [120, 170, 180, 130, 90], [70, 130, 160, 170, 130], [60, 70, 120, 140, 150]][v][o]::DOUBLE FROM (SELECT unnest(range(1, 6)) AS v), (SELECT unnest(range(1, 6)) AS o)
), i_pre AS (
    SELECT k.*, r.round_number, r.planted, r.plant_time, r.exploded, r.defused, r.defuse_time, coalesce(sw.swing, 1.0) AS sw, coalesce(tf.tf, 1.0) AS tf,
        CASE WHEN side = 'team-1' THEN alive_1 ELSE alive_2 END AS own, CASE WHEN side = 'team-1' THEN alive_2 ELSE alive_1 END AS opp,
        CASE WHEN ks.loadout < 1000 THEN 8 WHEN ks.loadout < 3250 THEN 6 WHEN ks.loadout < 4200 THEN 5 WHEN ks.loadout >= 4200 THEN 4 END AS kcode,
        CASE WHEN vs.loadout < 1000 THEN 8 WHEN vs.loadout < 3250 THEN 6 WHEN vs.loadout < 4200 THEN 5 WHEN vs.loadout >= 4200 THEN 4 END AS vcode,
        CASE WHEN (r.exploded AND r.planted AND k.t >= r.plant_time + 45) OR (r.defused AND k.t >= r.defuse_time) THEN 0 WHEN r.planted AND k.t BETWEEN r.plant_time + 38 AND r.plant_time + 45 THEN 1 WHEN r.planted AND k.t >= r.plant_time THEN 2 ELSE 3 END AS phase
    FROM i_alive k JOIN a_rounds r USING (round_id) LEFT JOIN i_swing sw ON sw.match_id = k.match_id AND sw.round_number = r.round_number AND sw.team = CASE WHEN k.side = 'team-1' THEN 'team-2' ELSE 'team-1' END
    LEFT JOIN i_tf tf ON tf.kill_id = k.kill_id LEFT JOIN a_stats ks ON ks.round_id = k.round_id AND ks.match_player_id = k.killer LEFT JOIN a_stats vs ON vs.round_id = k.round_id AND vs.match_player_id = k.victim
), i_kills AS (
    SELECT p.*, coalesce(w.w, 100.0) AS w, CASE WHEN self_kill THEN vcode::DOUBLE ELSE kcode / vcode END AS econ, CASE WHEN self_kill THEN 1.0 ELSE tf END * coalesce(w.w, 100.0) AS dob,
        CASE phase WHEN 0 THEN 0.5 WHEN 1 THEN 1.75 WHEN 2 THEN 1 + (t - plant_time) / 53 ELSE 1.0 END AS kt, CASE phase WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 1 + (t - plant_time) / 53 ELSE 1.0 END AS dt,
        NOT self_kill AND (own = 1 OR own = opp OR (own = 2 AND opp > 2)) AS kclutch, NOT self_kill AND (opp = 1 OR own = opp OR (opp = 2 AND own > 2)) AS vclutch,
        coalesce(planted AND t >= plant_time, FALSE) AS post, coalesce(NOT self_kill AND kcode <> vcode, FALSE) AS mism
    FROM i_pre p LEFT JOIN i_w w ON w.v = CASE WHEN self_kill THEN own ELSE opp END AND w.o = CASE WHEN self_kill THEN opp ELSE own END
), i_made AS (
    SELECT round_id, killer AS mp, count(*) AS k, sum(CASE WHEN self_kill THEN 0 ELSE greatest(0, 150 - 20 * (5 - opp)) END) AS acs, sum(CASE WHEN self_kill THEN 0 ELSE w * econ END) AS ke,
        sum(CASE WHEN self_kill THEN 0 ELSE w * kt END) AS kt, sum(CASE WHEN self_kill THEN 0 ELSE w * sw END) AS ks, sum(CASE WHEN kclutch THEN w ELSE 0 END) AS kc,
        sum(CASE WHEN post AND NOT self_kill THEN w * kt ELSE 0 END) AS kp, sum(CASE WHEN mism THEN w * econ ELSE 0 END) AS km FROM i_kills WHERE killer IS NOT NULL GROUP BY ALL
), i_taken AS (
    SELECT round_id, victim AS mp, sum(de) AS de, sum(dob * dt) AS dt, sum(dob * sw) AS ds, sum(CASE WHEN vclutch THEN dob ELSE 0 END) AS dc, sum(CASE WHEN post THEN dob * dt ELSE 0 END) AS dp, sum(CASE WHEN mism THEN de ELSE 0 END) AS dm
    FROM (SELECT *, dob * CASE WHEN NOT self_kill THEN econ WHEN econ = 4 THEN 0.9 WHEN econ = 5 THEN 0.85 WHEN econ = 6 THEN 0.75 ELSE 0.15 END AS de FROM i_kills) GROUP BY ALL
), i_sum AS (
    SELECT s.match_id, s.round_id, s.round_number, s.match_player_id, s.team, round_even(round((s.score - coalesce(acs, 0) + CASE WHEN k > 1 THEN 50 * k ELSE 0 END) * 1.25::DOUBLE, 6), 0)::BIGINT AS damage,
        coalesce(ke, 0) AS ke, coalesce(kt, 0) AS kt, coalesce(ks, 0) AS ks, coalesce(kc, 0) AS kc, coalesce(kp, 0) AS kp, coalesce(km, 0) AS km,
        coalesce(de, 0) AS de, coalesce(dt, 0) AS dt, coalesce(ds, 0) AS ds, coalesce(dc, 0) AS dc, coalesce(dp, 0) AS dp, coalesce(dm, 0) AS dm,
        (SELECT count(*) FROM i_trades t WHERE t.round_id = s.round_id AND t.trader = s.match_player_id) AS traded_teammate, (SELECT count(*) FROM i_trades t WHERE t.round_id = s.round_id AND t.traded = s.match_player_id) AS traded_by_teammate
    FROM a_stats s LEFT JOIN i_made m ON m.round_id = s.round_id AND m.mp = s.match_player_id LEFT JOIN i_taken d ON d.round_id = s.round_id AND d.mp = s.match_player_id
), i_impact AS MATERIALIZED (
    SELECT match_id, round_id, match_player_id, round_number, team, ki AS kill_impact, di AS death_impact, ki - di AS impact, damage,
        round_even(round(ke - de, 6), 0)::BIGINT AS econ_impact, round_even(round(kt - dt, 6), 0)::BIGINT AS time_impact, round_even(round(ks - ds, 6), 0)::BIGINT AS swing_impact, round_even(round(km, 6), 0)::BIGINT AS econ_kill, round_even(round(dm, 6), 0)::BIGINT AS econ_death,
        round_even(round(kc, 6), 0)::BIGINT AS clutch_kill, round_even(round(dc, 6), 0)::BIGINT AS clutch_death, round_even(round(kp, 6), 0)::BIGINT AS post_plant_kill, round_even(round(dp, 6), 0)::BIGINT AS post_plant_death, traded_teammate, traded_by_teammate
    FROM (SELECT *, round_even(round(damage + (ke + kt + ks) / 3, 6), 0)::BIGINT AS ki, round_even(round((de + dt + ds) / 3, 6), 0)::BIGINT AS di FROM i_sum)
)
"""


def scores(a):
    """The impact table: computed and written once, by match, and read by all that summarise it."""

    def steps():
        swings = a.by_match("swings", lambda: I.swing_risk(a.rounds, a.stats))
        kills = a.by_match("kill_factors", lambda: I.kill_factors(a.kill_events, a.rounds, a.match_players, a.stats, swings), FEED_ORDER)
        found = a.by_match("trades", lambda: I.trades(I.with_teams(a.kill_events, a.match_players)))
        return I.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats, kills, found)

    return a.by_match("impact", steps, SEAT_ORDER)


@query("d27_impact", "SELECT * FROM i_impact", IMPACT_SQL)
def d27(a):
    return scores(a)


@query("g1_impact_replay", "SELECT round_id, kill_id, alive_1, alive_2, self_kill FROM i_alive", IMPACT_SQL)
def g1(a):
    return I.alive_counts(I.with_teams(a.kill_events, a.match_players)).select("round_id", "kill_id", F.col("alive_1").cast("long").alias("alive_1"), F.col("alive_2").cast("long").alias("alive_2"), "self_kill")


@query("c9_trades", "SELECT round_id, kill_id, traded, trader FROM i_trades", IMPACT_SQL)
def c9(a):
    return I.trades(I.with_teams(a.kill_events, a.match_players)).select("round_id", "kill_id", "traded", "trader")


@query("f11_swing", "SELECT match_id, round_number, team, round(risk, 6) AS risk, round(realised, 6) AS realised, round(swing, 6) AS swing FROM i_swing", IMPACT_SQL)
def f11(a):
    return I.swing_risk(a.rounds, a.stats).select("match_id", "round_number", "team", *[r6(F.col(c)).alias(c) for c in ("risk", "realised", "swing")])


@query(
    "f_kill_factors",
    """SELECT kill_id, CASE WHEN self_kill THEN 0 ELSE w END AS kill_bonus, round(dob, 6) AS death_bonus, round(econ, 6) AS econ, round(kt, 6) AS kill_time_factor, round(dt, 6) AS death_time_factor,
        kclutch AS killer_clutch, vclutch AS victim_clutch, post AS post_plant, mism AS econ_mismatch FROM i_kills""",
    IMPACT_SQL,
)
def f_kill_factors(a):
    rows = I.kill_factors(a.kill_events, a.rounds, a.match_players, a.stats)
    load = a.stats.select("round_id", F.col("match_player_id").alias("killer"), F.col("loadout").alias("kl"))
    victim = load.select("round_id", F.col("killer").alias("victim"), F.col("kl").alias("vl"))
    info = a.rounds.select("round_id", "planted", "plant_time", "exploded", "defused", "defuse_time")
    rows = rows.join(load, ["round_id", "killer"], "left").join(victim, ["round_id", "victim"], "left").join(info, "round_id")
    clock = [F.col(c) for c in ("t", "planted", "plant_time", "exploded", "defused", "defuse_time")]
    return rows.select(
        "kill_id", "kill_bonus", r6(F.col("death_bonus")).alias("death_bonus"), r6(S.econ_factor(F.col("kl"), F.col("vl"), F.col("self_kill"))).alias("econ"), r6(S.time_factor(*clock)).alias("kill_time_factor"),
        r6(S.time_factor(*clock, for_death=True)).alias("death_time_factor"), "killer_clutch", "victim_clutch", "post_plant", F.coalesce("econ_mismatch", F.lit(False)).alias("econ_mismatch"),
    )


@query(
    "f_scalars",
    """SELECT round_id, match_player_id, CASE WHEN loadout < 1000 THEN 'SAVE' WHEN loadout < 3250 THEN 'ECO' WHEN loadout < 4200 THEN 'FORCE' ELSE 'FULL_BUY' END AS tier,
        CASE WHEN loadout < 1000 THEN 8 WHEN loadout < 3250 THEN 6 WHEN loadout < 4200 THEN 5 ELSE 4 END AS code, round(loadout / nullif(loadout + remaining, 0), 6) AS own_share FROM a_stats""",
)
def f_scalars(a):
    return a.stats.select("round_id", "match_player_id", S.econ_tier(F.col("loadout")).alias("tier"), S.tier_code(F.col("loadout")).alias("code"), r6(S.share(F.col("loadout"), F.col("remaining"))).alias("own_share"))


@query(
    "f_round_scalars",
    """SELECT round_id, winner, CASE WHEN round_number <= 12 THEN 'team-1' WHEN round_number <= 24 THEN 'team-2' END AS attacker, outcome IS NULL OR outcome NOT LIKE '%Surrendered Win' AS played,
        CASE WHEN contains(outcome, 'Elimination') THEN 'ELIMINATION' WHEN contains(outcome, 'Detonate') THEN 'DETONATE' WHEN contains(outcome, 'Defuse') THEN 'DEFUSE' WHEN contains(outcome, 'Time') THEN 'TIME' END AS cause FROM a_win""",
)
def f_round_scalars(a):
    o = F.col("outcome")
    return a.rounds.select("round_id", S.winner(o).alias("winner"), S.attacking_team(F.col("round_number")).alias("attacker"), S.played(o).alias("played"), S.terminal_cause(o).alias("cause"))
