"""Queries on players, matches and economy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as P
from .base import query
from .scoring import IMPACT_SQL, scores

query("d1_matches_per_name", "SELECT display_name, count(*) AS matches FROM a_match_players JOIN a_players USING (player_id) GROUP BY ALL")(lambda a: P.matches_per_name(a.match_players, a.players))
query("d2_kda", "SELECT match_player_id, sum(kills)::BIGINT AS kills, sum(deaths)::BIGINT AS deaths, sum(assists)::BIGINT AS assists FROM a_stats GROUP BY ALL")(lambda a: P.kda(a.stats))
query(
    "d3_kda_rollup",
    """SELECT player_id, s.match_id, sum(kills)::BIGINT AS kills, sum(deaths)::BIGINT AS deaths, sum(assists)::BIGINT AS assists FROM a_stats s JOIN a_match_players p USING (match_player_id)
    GROUP BY GROUPING SETS ((player_id, s.match_id), (player_id))""",
)(lambda a: P.kda_rollup(a.stats, a.match_players))
query(
    "d4_acquaintances",
    "SELECT a.player_id, b.player_id AS other_id, count(DISTINCT a.match_id) AS matches FROM a_match_players a JOIN a_match_players b ON a.match_id = b.match_id AND a.player_id <> b.player_id GROUP BY ALL HAVING count(DISTINCT a.match_id) >= 2",
)(lambda a: P.acquaintances(a.match_players))
query("d5_map_popularity", "SELECT map_name, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT map_name, count(*) AS n FROM a_matches GROUP BY ALL HAVING count(*) >= 3)")(lambda a: P.popularity(a.matches))
ACT_SQL = "b_acts AS (SELECT m.*, act_id FROM a_matches m JOIN a_acts ON played_at >= act_start AND (act_end IS NULL OR played_at < act_end))"
query("c11_act_lookup", "SELECT match_id, act_id FROM b_acts", ACT_SQL)(lambda a: P.in_acts(a.matches, a.acts).select("match_id", "act_id"))
query("d6_act_pools", "SELECT act_id, map_name, count(*) AS n FROM b_acts GROUP BY ALL HAVING count(*) >= 3", ACT_SQL)(lambda a: P.act_pools(a.matches, a.acts))
RESULT_SQL = (
    IMPACT_SQL
    + """, p_res AS (SELECT i.*, w.winner, w.outcome, coalesce(w.winner = i.team, FALSE) AS won, CASE WHEN w.winner = i.team THEN kill_impact ELSE 0 END - death_impact AS win_impact FROM i_impact i JOIN a_win w USING (round_id)),
p_mp AS (SELECT match_player_id, player_id, agent_no FROM a_match_players)"""
)
SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in P.PARTS)
query(
    "d7_match_summary",
    f"""SELECT match_id, match_player_id, team, count(*) AS rounds, round(avg(impact), 6) AS avg_impact, round(avg(kill_impact), 6) AS avg_kill, round(avg(death_impact), 6) AS avg_death, round(avg(win_impact), 6) AS round_win_impact, {SUMS}
    FROM p_res GROUP BY ALL""",
    RESULT_SQL,
)(lambda a: P.match_summary(scores(a), a.rounds))
query("d8_impact_by_round", "SELECT match_player_id, len(list(impact)) AS n, list(impact ORDER BY round_number)[1] AS first, list(impact ORDER BY round_number)[-1] AS last FROM i_impact GROUP BY ALL", IMPACT_SQL)(
    lambda a: P.impact_by_round(scores(a)).select("match_player_id", F.size("by_round").alias("n"), F.map_values("by_round")[0].alias("first"), F.element_at(F.map_values("by_round"), -1).alias("last"))
)
query(
    "d10_team_summary",
    "SELECT i.match_id, team, sum(impact)::BIGINT AS total_impact, n_rounds, round(sum(impact) / n_rounds, 6) AS avg_impact FROM i_impact i JOIN (SELECT match_id, count(*) AS n_rounds FROM a_rounds GROUP BY ALL) n USING (match_id) GROUP BY i.match_id, team, n_rounds",
    IMPACT_SQL,
)(lambda a: P.team_summary(scores(a), a.rounds))
PER = ", ".join(f"round(sum({c}) / count(DISTINCT match_id), 6) AS {c}_per_match" for c in P.PARTS)
query("d11_profile", f"SELECT player_id, count(DISTINCT match_id) AS matches_with_scores, count(*) AS rounds, round(avg(impact), 6) AS avg_impact, {PER} FROM i_impact JOIN (SELECT match_player_id, player_id FROM a_match_players) USING (match_player_id) GROUP BY ALL", IMPACT_SQL)(
    lambda a: P.profile(scores(a), a.match_players)
)
for _key in ("agent_no", "map_name"):
    query(
        f"d12_by_{_key.split('_')[0]}",
        f"""SELECT player_id, {_key}, count(*) AS matches, round(avg(m), 6) AS avg_impact, count(*) FILTER (o > e) AS wins, round(count(*) FILTER (o > e) / nullif(count(*) FILTER (o <> e), 0), 6) AS win_rate
        FROM (SELECT p.player_id, p.agent_no, m.map_name, i.m, CASE WHEN p.team = 'team-1' THEN team1_rounds_won ELSE team2_rounds_won END AS o, CASE WHEN p.team = 'team-1' THEN team2_rounds_won ELSE team1_rounds_won END AS e
            FROM a_match_players p JOIN (SELECT match_player_id, avg(impact) AS m FROM i_impact GROUP BY ALL) i USING (match_player_id) JOIN a_matches m ON m.match_id = p.match_id) GROUP BY ALL""",
        IMPACT_SQL,
    )(lambda a, key=_key: P.grouped_profile(scores(a), a.match_players, a.matches, key))
query(
    "d14_leaderboard",
    """SELECT player_id, count(*) AS rounds, round(avg(impact), 6) AS avg_impact, round(avg(win_impact), 6) AS avg_win_impact, count(*) FILTER (won) AS rounds_won, count(*) FILTER (winner IS NOT NULL AND NOT won) AS rounds_lost
    FROM p_res JOIN p_mp USING (match_player_id) WHERE outcome IS NULL OR outcome NOT LIKE '%Surrendered Win' GROUP BY ALL""",
    RESULT_SQL,
)(lambda a: P.leaderboard(scores(a), a.rounds, a.match_players))
query("d15_main_agent", "SELECT player_id, agent_no, n FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, agent_no) AS r FROM (SELECT player_id, agent_no, count(*) AS n FROM a_match_players GROUP BY ALL)) WHERE r = 1")(
    lambda a: P.main_agent(a.match_players)
)
query(
    "d16_stat_counters",
    """SELECT match_player_id, count(*) FILTER (kills >= 3) AS multi_kill_rounds, sum(CASE WHEN loadout < 3250 THEN kills ELSE 0 END)::BIGINT AS eco_kills, sum(CASE WHEN loadout >= 5100 THEN kills ELSE 0 END)::BIGINT AS sniper_kills,
    count(*) FILTER (kills > 0 OR assists > 0) AS active_rounds FROM a_stats GROUP BY ALL""",
)(lambda a: P.stat_counters(a.stats))
query(
    "d17_biggest_multi_kill",
    """SELECT s.match_id, s.kills, string_agg(DISTINCT split_part(display_name, '#', 1), ', ' ORDER BY split_part(display_name, '#', 1)) AS holders FROM a_stats s
    JOIN (SELECT match_id, max(kills) AS kills FROM a_stats GROUP BY ALL) t USING (match_id, kills) JOIN p_mp USING (match_player_id) JOIN a_players USING (player_id) WHERE s.kills > 0 GROUP BY ALL""",
    "p_mp AS (SELECT match_player_id, player_id FROM a_match_players)",
)(lambda a: P.biggest_multi_kill(a.stats, a.match_players, a.players))
query(
    "d18_feed_counters",
    """SELECT killer AS match_player_id, count(*) FILTER (t <= 20) AS entry_kills, count(*) FILTER (t >= 60) AS late_kills, count(*) FILTER (t >= plant_time) AS post_plant_kills
    FROM a_kills JOIN a_rounds USING (round_id) WHERE killer <> victim GROUP BY ALL""",
)(lambda a: P.feed_counters(a.kill_events, a.rounds))
query(
    "d19_upset_deaths",
    """SELECT victim AS match_player_id, count(*) AS n FROM a_kills k JOIN a_stats a ON a.round_id = k.round_id AND a.match_player_id = k.killer JOIN a_stats b ON b.round_id = k.round_id AND b.match_player_id = k.victim
    WHERE killer <> victim AND a.loadout < 3250 AND b.loadout >= 3250 GROUP BY ALL""",
)(lambda a: P.upset_deaths(a.kill_events, a.stats))
query("d19_spike_deaths", "SELECT victim AS match_player_id, count(*) AS n FROM a_kills WHERE weapon IN ('Environmental', 'Bomb') GROUP BY ALL")(lambda a: P.spike_deaths(a.kill_events))
query("d19_ghost_rounds", "SELECT match_player_id, count(*) AS n FROM a_stats WHERE kills = 0 AND deaths = 0 AND assists = 0 GROUP BY ALL")(lambda a: P.ghost_rounds(a.stats))
query(
    "d20_round_mvps",
    """SELECT match_player_id, count(*) FILTER (r = 1) AS mvps, max(impact) AS best FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY impact DESC, match_player_id) AS r FROM p_res
    WHERE outcome IS NULL OR outcome NOT LIKE '%Surrendered Win') GROUP BY match_player_id""",
    RESULT_SQL,
)(lambda a: P.round_mvps(scores(a), a.rounds))
query("d29_meters", "SELECT match_id, round_id, match_player_id, sign(impact) * ((2000000 * abs(impact) + top) // nullif(2 * top, 0)) / 1e6::DOUBLE AS meter FROM (SELECT *, max(abs(impact)) OVER (PARTITION BY round_id) AS top FROM i_impact)", IMPACT_SQL)(lambda a: P.meters(scores(a)))
ECON_SQL = """e_mean AS (SELECT match_id, round_number, team, (sum(loadout) // count(*))::BIGINT AS m FROM a_stats GROUP BY ALL),
e_tier AS (SELECT *, CASE WHEN round_number IN (1, 13) THEN 'PISTOL' WHEN m >= 4200 THEN 'FULL_BUY' ELSE 'ECO' END AS tier FROM e_mean),
e_rows AS (SELECT a.match_id, a.round_number, a.team, a.m AS own, b.m AS enemy, a.tier AS own_tier, b.tier AS enemy_tier, w.winner = a.team AS won FROM e_tier a JOIN e_tier b ON a.match_id = b.match_id AND a.round_number = b.round_number AND a.team <> b.team
    JOIN a_win w ON w.match_id = a.match_id AND w.round_number = a.round_number WHERE w.winner IS NOT NULL)"""
query("d23_round_econ", "SELECT match_id, round_number, team, m AS mean_loadout FROM e_mean", ECON_SQL)(lambda a: P.round_econ(a.stats))
query("i5_econ_samples", "SELECT * FROM e_rows", ECON_SQL)(lambda a: P.econ_samples(a.stats, a.rounds))
query(
    "d24_tier_matrix",
    """SELECT own_tier, enemy_tier, count(*) FILTER (won) AS wins, count(won) AS total, round(100 * count(*) FILTER (won) / nullif(count(won), 0), 6) AS win_pct, round(avg(own / nullif(own + enemy, 0)), 6) AS own_share
    FROM (SELECT a AS own_tier, b AS enemy_tier FROM (VALUES ('ECO'), ('FULL_BUY')) x(a), (VALUES ('ECO'), ('FULL_BUY')) y(b)) LEFT JOIN e_rows USING (own_tier, enemy_tier) GROUP BY ALL""",
    ECON_SQL,
)(lambda a: P.tier_matrix(P.econ_samples(a.stats, a.rounds)))
query("d25_pistols", "SELECT team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses FROM e_rows WHERE own_tier = 'PISTOL' GROUP BY ALL", ECON_SQL)(lambda a: P.pistols(P.econ_samples(a.stats, a.rounds)))
query(
    "d26_share_histogram",
    """SELECT bucket, wins, total, round(100 * wins / total, 6) AS win_pct, round(2 + 14 * total / max(total) OVER (), 6) AS radius FROM (
        SELECT least(floor(floor(own / nullif(own + enemy, 0) * 100) / 5), 19)::BIGINT AS bucket, count(*) FILTER (won) AS wins, count(*) AS total FROM e_rows WHERE own + enemy > 0 GROUP BY ALL)""",
    ECON_SQL,
)(lambda a: P.share_histogram(P.econ_samples(a.stats, a.rounds)))
query(
    "d28_round_log",
    """SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY t, kind, actor NULLS FIRST, target NULLS FIRST) AS step FROM (
        SELECT match_id, round_id, 'kill' AS kind, t, killer AS actor, victim AS target FROM a_kills UNION ALL SELECT match_id, round_id, 'plant', plant_time, NULL, NULL FROM a_rounds WHERE planted
        UNION ALL SELECT match_id, round_id, 'defuse', defuse_time, NULL, NULL FROM a_rounds WHERE defused)""",
)(lambda a: P.round_log(a.kill_events, a.rounds))
