"""Queries on friends, squads, shoutouts, event windows and page strings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.scoring import played, r6
from ..operators import economy, standing
from ..operators import replay as R
from ..operators import social as S
from ..operators import summaries as P
from ..operators.statistics import average_ranks
from ..sources import icons, ingest
from ..sources.arena import PLAYER_ORDER
from ..sources.tables import written
from ..streaming.live import windowed_counts
from .base import query
from .scoring import IMPACT_SQL, scores
from .sessions import CREDIT_SQL
from .summaries import RESULT_SQL

SHARED_SQL = RESULT_SQL + """, q_side AS (SELECT r.*, p.player_id FROM p_res r JOIN p_mp p USING (match_player_id)),
q_shared AS (SELECT o.match_id, o.round_id, f.owner_id, f.friend_id, o.won, o.win_impact, x.win_impact AS fwi, o.traded_teammate, x.traded_teammate AS ft FROM q_side o JOIN a_friends f ON f.owner_id = o.player_id JOIN q_side x ON x.round_id = o.round_id AND x.team = o.team AND x.player_id = f.friend_id),
q_pairs AS (SELECT owner_id, friend_id, count(DISTINCT match_id) AS matches, count(*) AS rounds, round(count(*) FILTER (won) / count(*), 6) AS win_rate, round(avg(win_impact + fwi), 6) AS avg_impact, sum(traded_teammate + ft)::BIGINT AS trades FROM q_shared GROUP BY ALL)"""


def pairs(a):
    return S.squad(S.shared_rounds(scores(a), a.rounds, a.match_players, a.friendships))


query("d22_squad", "SELECT * FROM q_pairs", SHARED_SQL)(pairs)
query("k3_eligible_pairs", "SELECT owner_id, friend_id, rounds FROM q_pairs WHERE rounds >= 20", SHARED_SQL)(lambda a: S.eligible(pairs(a)).select("owner_id", "friend_id", "rounds"))
query("c6_friends", "SELECT owner_id, friend_id, display_name FROM a_friends JOIN a_players ON player_id = friend_id")(lambda a: a.friendships.join(a.players, F.col("player_id") == F.col("friend_id")).select("owner_id", "friend_id", "display_name"))
query(
    "c7_friend_teammates",
    "SELECT f.owner_id, f.friend_id, count(*) AS matches FROM a_friends f JOIN a_match_players a ON a.player_id = f.owner_id JOIN a_match_players b ON b.match_id = a.match_id AND b.team = a.team AND b.player_id = f.friend_id GROUP BY ALL",
)(
    lambda a: a.match_players.select("match_id", "team", F.col("player_id").alias("owner_id"))
    .join(a.friendships, "owner_id")
    .join(a.match_players.select("match_id", "team", F.col("player_id").alias("friend_id")), ["match_id", "team", "friend_id"])
    .groupBy("owner_id", "friend_id")
    .agg(F.count("*").alias("matches"))
)


def shout_values(a):
    """Four categories per match from the counters of each player."""
    base = a.match_players.select("match_id", "match_player_id", "player_id").join(P.stat_counters(a.stats), "match_player_id").join(P.feed_counters(a.kill_events, a.rounds), "match_player_id", "left").na.fill(0)
    names = ["entry_kills", "post_plant_kills", "multi_kill_rounds", "late_kills", "eco_kills", "active_rounds"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.lit(i).cast("long").alias("priority"), F.col(n).cast("long").alias("value")) for i, n in enumerate(names)]))
    return base.join(a.players, "player_id").select(F.col("match_id").alias("scope_id"), "player_id", F.col("display_name").alias("name"), rows.alias("c")).select("scope_id", "player_id", "name", "c.*")


COUNTERS = """k_base AS (SELECT p.match_id, p.player_id, p.match_player_id, s.*, coalesce(f.entry_kills, 0) AS entry_kills, coalesce(f.late_kills, 0) AS late_kills, coalesce(f.post_plant_kills, 0) AS post_plant_kills FROM a_match_players p
    JOIN (SELECT match_player_id AS sid, count(*) FILTER (kills >= 3) AS multi_kill_rounds, sum(CASE WHEN loadout < 3250 THEN kills ELSE 0 END)::BIGINT AS eco_kills, count(*) FILTER (kills > 0 OR assists > 0) AS active_rounds FROM a_stats GROUP BY ALL) s ON s.sid = p.match_player_id
    LEFT JOIN (SELECT killer, count(*) FILTER (t <= 20) AS entry_kills, count(*) FILTER (t >= 60) AS late_kills, count(*) FILTER (t >= plant_time) AS post_plant_kills FROM a_kills JOIN a_rounds USING (round_id) WHERE killer <> victim GROUP BY ALL) f ON f.killer = p.match_player_id),
k_val AS (SELECT match_id, player_id, unnest([{'c': 'entry_kills', 'v': entry_kills}, {'c': 'post_plant_kills', 'v': post_plant_kills}, {'c': 'multi_kill_rounds', 'v': multi_kill_rounds}, {'c': 'late_kills', 'v': late_kills}, {'c': 'eco_kills', 'v': eco_kills}, {'c': 'active_rounds', 'v': active_rounds}]) AS x FROM k_base)"""
query(
    "e5_shoutout_candidates",
    "SELECT scope_id, category, player_id, value, rank FROM (SELECT match_id AS scope_id, x.c AS category, player_id, x.v AS value, row_number() OVER (PARTITION BY match_id, x.c ORDER BY x.v DESC, 'P' || player_id || '#T', player_id) - 1 AS rank FROM k_val WHERE x.v > 0) WHERE rank < 5",
    COUNTERS,
)(lambda a: S.candidates(shout_values(a)).select("scope_id", "category", "player_id", "value", "rank"))
query("k1_shoutouts")(lambda a: S.assign_shoutouts(S.candidates(shout_values(a))))


def replayed(a):
    return a.by_match("set_replay", lambda: R.set_replay(a.kill_events, a.match_players))


def clutch_resolvers(a):
    """Of played rounds; written by match, as the replay and the credits are, for all that count them."""
    return a.by_match("clutch_resolvers", lambda: standing.clutch_resolvers(a.kill_events, a.rounds.where(played(F.col("outcome"))), a.match_players, replayed(a)))


def credits(a):
    return a.by_match("credits", lambda: economy.credits(a.stats, a.rounds, a.match_players))


def round_facts(a):
    """Per round and match player what shared rounds are told about: kills, deaths, whether one resolved a clutch, credits."""
    clutch = clutch_resolvers(a).select("match_id", "round_id", "match_player_id", F.lit(1).alias("clutch"))
    facts = a.stats.select("match_id", "round_id", "round_number", "match_player_id", "kills", "deaths").join(clutch, ["match_id", "round_id", "match_player_id"], "left")
    return facts.join(credits(a), ["match_id", "round_number", "match_player_id"], "left").drop("round_number")


def match_values(a):
    """(scope_id, player_id, name, category, priority, value, matches, rounds): all categories of a match, from one row of counters per player."""
    key = ["match_id", "match_player_id"]
    feed, stats, impact = a.kill_events, a.stats, scores(a)
    sums = stats.groupBy(*key).agg(F.count("*").alias("rounds"))
    # Written by themselves: one task would otherwise hold the sorts of all counters.
    streaks = a.by_match("kill_streaks", lambda: R.kill_streaks(feed, a.rounds, a.match_players, replayed(a), ("match_id",)), PLAYER_ORDER)
    stood = a.by_match("standing_counters", lambda: standing.standing_counters(feed, a.rounds, a.match_players, stats, replayed(a)), PLAYER_ORDER)
    counters = [
        P.feed_counters(feed, a.rounds, "match_id"), P.stat_counters(stats, "match_id"), streaks, stood,
        clutch_resolvers(a).groupBy(*key).agg(F.count("*").alias("clutches")),
        credits(a).groupBy(*key).agg(F.sum("sugar").alias("sugar"), F.sum("scavenger").alias("scavenger")),
        impact.groupBy(*key).agg(F.sum("traded_teammate").alias("traded_teammate"), F.sum("traded_by_teammate").alias("traded_by_teammate")),
        P.round_mvps(impact, a.rounds, "match_id"),
    ]
    seats = a.match_players.select(*key, "player_id")
    # Names meet the narrow seats: the wide rows of a player in very many matches would all have to go to one task.
    named = seats.join(seats.select("player_id").distinct().join(a.players, "player_id"), "player_id")
    wide = sums.join(named, key)
    for one in counters:
        on = [c for c in key if c in one.columns]
        wide = wide.join(one.select(*on, *[c for c in one.columns if c in S.MATCH_COUNTERS]), on, "left")
    wide = wide.select(F.col("match_id").alias("scope_id"), "player_id", F.col("display_name").alias("name"), F.lit(1).alias("matches"), "rounds", *S.MATCH_COUNTERS)
    return S.stacked(wide, ["scope_id", "player_id", "name", "matches", "rounds"], S.MATCH_CATEGORIES).select("scope_id", "player_id", "name", "category", "priority", "value", "matches", "rounds")


def squad_counters(a):
    facts = a.by_match("round_facts", lambda: round_facts(a))
    return S.pair_counters(S.shared_rounds(scores(a), a.rounds, a.match_players, a.friendships, facts))


def _told_squads(a):
    """A shoutout for each friend of each owner with enough rounds together; a friend left over is told how long both played."""
    wide = S.eligible(a.kept("squad_counters", lambda: squad_counters(a))).join(a.players.select(F.col("player_id").alias("friend_id"), F.col("display_name").alias("name")), "friend_id")
    wide = wide.withColumn("scope_id", F.col("owner_id")).withColumn("player_id", F.col("friend_id"))
    values = S.stacked(wide, ["scope_id", "player_id", "name"], S.SQUAD_CATEGORIES)
    _, headline, told = next(c for c in S.SQUAD_CATEGORIES if c[0] == "rounds")
    anchors = wide.select("scope_id", "player_id", F.lit(headline).alias("headline"), F.replace(F.replace(F.lit(told), F.lit("{v}"), F.col("rounds").cast("string")), F.lit("{s}"), F.lit("s")).alias("detail"))
    no_rounds = wide.select("scope_id", "player_id", F.lit(None).cast("double").alias("impact")).where("false")
    return S.told_shoutouts(wide, S.assign_shoutouts(S.candidates(values)), values, no_rounds, anchors, S.SQUAD_CATEGORIES)


def _told(a):
    values = S.eligible_values(a.kept("shout_values", lambda: match_values(a)))
    roster = a.match_players.select(F.col("match_id").alias("scope_id"), "player_id")
    best = scores(a).groupBy("match_id", "match_player_id").agg(F.max("impact").alias("impact")).join(a.match_players.select("match_id", "match_player_id", "player_id"), ["match_id", "match_player_id"])
    return S.told_shoutouts(roster, S.assign_shoutouts(S.candidates(values)), values, best.select(F.col("match_id").alias("scope_id"), "player_id", "impact"))


CATALOGUE = ", ".join("('%s', '%s', '%s')" % (c, h.replace("'", "''"), t.replace("'", "''")) for c, h, t in S.MATCH_CATEGORIES)
query(
    "k2_catalogue",
    f"SELECT match_id AS scope_id, player_id, headline, replace(replace(told, '{{v}}', v::VARCHAR), '{{s}}', CASE WHEN v = 1 THEN '' ELSE 's' END) AS detail FROM (SELECT match_id, player_id, x.c AS c, x.v AS v FROM k_val WHERE x.v > 0) JOIN (VALUES {CATALOGUE}) t(c, headline, told) USING (c)",
    COUNTERS,
)(lambda a: S.told_values(shout_values(a).where("value > 0")))
SQUAD_SQL = (
    SHARED_SQL.replace(", q_side AS (SELECT r.*, p.player_id FROM p_res r JOIN p_mp p USING (match_player_id))", ", q_side AS (SELECT r.*, p.player_id, s.kills, s.deaths, c.sugar, c.scavenger FROM p_res r JOIN p_mp p USING (match_player_id) JOIN (SELECT round_id, match_player_id, kills, deaths FROM a_stats) s USING (round_id, match_player_id) LEFT JOIN c_credits c USING (round_id, match_player_id))")
    .replace("x.traded_teammate AS ft FROM", "x.traded_teammate AS ft, o.kills + x.kills - o.deaths - x.deaths AS surplus, coalesce(o.sugar, 0) + coalesce(x.sugar, 0) AS sugar, coalesce(o.scavenger, 0) + coalesce(x.scavenger, 0) AS scavenger FROM")
)
query(
    "k2_squad_counters",
    "SELECT owner_id, friend_id, round_even(100 * count(*) FILTER (won) / count(*), 0)::BIGINT AS win_percent, round_even(avg(win_impact + fwi), 0)::BIGINT AS avg_impact, sum(traded_teammate + ft)::BIGINT AS trades, count(*) AS rounds, sum(surplus)::BIGINT AS kill_surplus, sum(sugar)::BIGINT AS sugar, sum(scavenger)::BIGINT AS scavenger FROM q_shared GROUP BY ALL",
    CREDIT_SQL + ", " + SQUAD_SQL,
)(lambda a: a.kept("squad_counters", lambda: squad_counters(a)).drop("clutches"))
query("k1_squad_shoutouts")(_told_squads)
query(
    "k3_eligible_values",
    """SELECT s.match_id AS scope_id, p.player_id, 'sniper_kills' AS category, sum(CASE WHEN loadout >= 5100 THEN kills ELSE 0 END)::BIGINT AS value FROM a_stats s JOIN (SELECT match_player_id, player_id FROM a_match_players) p USING (match_player_id)
    GROUP BY ALL HAVING sum(CASE WHEN loadout >= 5100 THEN kills ELSE 0 END) >= 1""",
)(lambda a: S.eligible_values(a.kept("shout_values", lambda: match_values(a))).where("category = 'sniper_kills'").select("scope_id", "player_id", "category", "value"))
query("k1_told_shoutouts")(_told)
query("e8_average_ranks", "SELECT match_player_id, round(rank() OVER (PARTITION BY match_id ORDER BY score) + (count(*) OVER (PARTITION BY match_id, score) - 1) / 2, 6) AS score_rank FROM (SELECT match_id, match_player_id, sum(score) AS score FROM a_stats GROUP BY ALL)")(
    lambda a: average_ranks(a.stats.groupBy("match_id", "match_player_id").agg(F.sum("score").alias("score")), "match_id", "score", "score_rank").select("match_player_id", r6(F.col("score_rank")).alias("score_rank"))
)
query("l_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda a: windowed_counts(a.raw("events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
query(
    "a13_file_names",
    """SELECT match_id, map_name, TIMESTAMP '2024-01-01 13:30:00' + to_days((d - 1)::INTEGER) + to_months((mo - 1)::INTEGER) AS played_at FROM (SELECT match_id, 'Split' AS map_name, 10 + match_id % 3 AS mo, 10 + match_id % 19 AS d FROM a_matches)""",
)(
    lambda a: ingest.parse_file_names(a.matches.select("match_id", F.concat(F.lit("Split"), (10 + F.col("match_id") % 3).cast("string"), (10 + F.col("match_id") % 19).cast("string"), F.lit("0130")).alias("file")))
    .select("match_id", "map_name", F.col("played_at").cast("timestamp_ntz").alias("played_at"))
)
query("b6_name_lookup", "SELECT player_id, display_name FROM a_players WHERE split_part(display_name, '#', 1) ILIKE 'p1%'")(lambda a: a.players.where(F.split_part("display_name", F.lit("#"), F.lit(1)).ilike("p1%")))
query("e4_match_list", "SELECT match_id, external_id, map_name, played_at, row_number() OVER (ORDER BY played_at DESC NULLS LAST, match_id DESC) AS place FROM a_matches ORDER BY place LIMIT 50")(
    lambda a: a.matches.select("match_id", "external_id", "map_name", "played_at").orderBy(F.col("played_at").desc_nulls_last(), F.desc("match_id")).limit(50).withColumn("place", F.row_number().over(Window.orderBy(F.col("played_at").desc_nulls_last(), F.desc("match_id"))))
)
query("f20_labels", "SELECT player_id, split_part(display_name, '#', 1) AS name, lower(replace(display_name, '/', '')) AS slug, CASE WHEN player_id = 1 THEN '' ELSE 's' END AS ending, round_even(player_id * 7 % 101, 0)::INT || '%' AS share FROM a_players")(
    lambda a: a.players.select("player_id", text.strip_tag(F.col("display_name")).alias("name"), text.slug(F.col("display_name")).alias("slug"), text.plural(F.col("player_id")).alias("ending"), text.percent(F.col("player_id") * 7 % 101 / 100).alias("share"))
)
query(
    "a19_impact_snapshot",
    "SELECT external_id AS match_external_id, round_number, round_id, i.match_player_id, display_name AS player_name, i.team, kill_impact, death_impact, impact FROM i_impact i JOIN (SELECT match_player_id, player_id FROM a_match_players) p USING (match_player_id) JOIN (SELECT match_id, external_id FROM a_matches) m USING (match_id) JOIN a_players USING (player_id)",
    IMPACT_SQL,
)(lambda a: ingest.impact_snapshot(scores(a), a.match_players, a.matches, a.players))
def match_pictures(a):
    """A picture of each match of 8 x 9 pixels: its eliminations by victim's seat and by twelve seconds of the round."""
    at = F.least(F.floor(F.col("t") / 12), F.lit(8)).cast("int")
    cells = a.kill_events.where("victim is not null").groupBy("match_id", (F.col("victim") % 10 % 8).cast("int").alias("y"), at.alias("x")).agg(F.count("*").alias("n"))
    held = cells.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct(9 * F.col("y") + F.col("x"), F.col("n")))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: F.coalesce(F.element_at("m", 9 * y + x), F.lit(0)).cast("double")))
    return held.select(F.col("match_id").alias("icon_id"), grid.alias("pixels"))


def _picture_labels(a):
    """Each match's hash, and the map whose first match looks like it, if any does."""
    hashes = written(icons.hash_pictures(match_pictures(a)), "pictures")
    named = a.matches.groupBy("map_name").agg(F.min("match_id").alias("icon_id"))
    known = hashes.join(named, "icon_id").select("hash", F.col("map_name").alias("label"))
    return ingest.classify_icons(hashes, known).join(hashes, "icon_id").select("icon_id", "hash", "label")


query(
    "a11_pictures",
    """SELECT icon_id, h.hash, coalesce(k.label, 'BAD CLASSIFICATION!') AS label FROM k_hash h LEFT JOIN (
        SELECT h.icon_id, min({'d': bit_count(xor(h.hash, r.hash)), 'l': label}).l AS label FROM k_hash h, k_known r WHERE bit_count(xor(h.hash, r.hash)) <= 5 GROUP BY h.icon_id) k USING (icon_id)""",
    """k_cell AS (SELECT match_id, (victim % 10 % 8)::INT AS y, least(floor(t / 12), 8)::INT AS x, count(*) AS n FROM a_kills WHERE victim IS NOT NULL GROUP BY ALL),
    k_grid AS (SELECT match_id, y, x FROM (SELECT DISTINCT match_id FROM k_cell) m CROSS JOIN (SELECT unnest(range(8))::INT AS y) CROSS JOIN (SELECT unnest(range(9))::INT AS x)),
    k_full AS (SELECT g.match_id, g.y, g.x, coalesce(n, 0) AS n FROM k_grid g LEFT JOIN k_cell c ON c.match_id = g.match_id AND c.y = g.y AND c.x = g.x),
    k_bits AS (SELECT match_id, 8 * y + x - 1 AS k, n > lag(n) OVER (PARTITION BY match_id, y ORDER BY x) AS up FROM k_full),
    k_sum AS (SELECT match_id, sum(CASE WHEN up AND k > 0 THEN 1::HUGEINT << (63 - k)::INT ELSE 0 END) + min(CASE WHEN up AND k = 0 THEN -(1::HUGEINT << 63) ELSE 0 END) AS h FROM k_bits WHERE up IS NOT NULL GROUP BY match_id),
    k_hash AS MATERIALIZED (SELECT match_id AS icon_id, h::BIGINT AS hash FROM k_sum),
    k_known AS (SELECT hash, map_name AS label FROM (SELECT map_name, min(match_id) AS icon_id FROM a_matches GROUP BY map_name) JOIN k_hash USING (icon_id))""",
)(_picture_labels)
query(
    "a11_icons",
    "SELECT icon_id, coalesce(arg_min(label, bit_count(xor(hash, h)) * 1000 + label[2:]::INT) FILTER (bit_count(xor(hash, h)) <= 5), 'BAD CLASSIFICATION!') AS label FROM k_icon, k_ref GROUP BY icon_id",
    "k_icon AS (SELECT match_id AS icon_id, xor(match_id % 37 * 1000003, 1::BIGINT << (match_id % 17)::INT) AS hash FROM a_matches), k_ref AS (SELECT i * 1000003 AS h, 'R' || i AS label FROM (SELECT unnest(range(0, 30)) AS i))",
)(lambda a: ingest.classify_icons(_icons(a), a.spark.range(30).select((F.col("id") * 1000003).alias("hash"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("label"))))


def _icons(a):
    m = F.col("match_id")
    return a.matches.select(m.alias("icon_id"), (m % 37 * 1000003).bitwiseXOR(F.expr("shiftleft(1L, cast(match_id % 17 as int))")).alias("hash"))
