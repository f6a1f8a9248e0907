"""The arena: match tables derived from the star-schema tables by integer arithmetic.

A match is 26 consecutive orders, each of them a round; line items are the
elimination feed. All derivations are per row, per round or per match. The matches, seats,
rounds, feed and statistics are written once, as an ingest would, in buckets by
match; every window, grouping and join that has the match among its keys then
works on these, without any shuffle. A match is a few hundred rows, so no bucket
is skewed. Customers are the players, those who were once in a team are friends, and acts follow from when
matches were played.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .tables import as_it_lies, kept, parts_of

TEAM_1, TEAM_2 = "team-1", "team-2"
FIRST_ACT, ACT_DAYS = "2024-01-01", 14

#: Rounds, and eliminations, of a bucket: what a task holds and sorts stays the same however large the tables are.
ROUNDS_A_PART, KILLS_A_PART = 20_000, 80_000

#: The orders that buckets are sorted in: by round, by round and player, by seat, and the feed's.
ROUND_ORDER, SEAT_ORDER, PLAYER_ORDER, FEED_ORDER = (("match_id", *k) for k in (("round_id",), ("round_id", "match_player_id"), ("match_player_id",), ("round_id", "seq")))

#: The largest id of the recurring players, who come first.
REGULARS = 25


def div(x: Column, n: int) -> Column:
    return F.floor(x / F.lit(float(n))).cast("long")


class Arena:
    """The tables over one input folder; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        # Sides that are both dealt by match join on the match and more without being dealt again.
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # A bucket in one file is read in the order that it was sorted in, and by one task: joins and windows of rounds needn't sort it.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def by_match(self, name: str, build: Callable[[], DataFrame], order: Sequence[str] = ()) -> DataFrame:
        """A table derived from this folder, in buckets by match, each sorted by ``order``."""
        return kept(self.spark, self.dir, name, build, "match_id", self.parts, order)

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from this folder, as it was written."""
        return kept(self.spark, self.dir, name, build, n=self.parts)

    @cached_property
    def parts(self) -> int:
        """The buckets of its tables, which grow in number with rounds and eliminations."""
        count = lambda: max(-(-self.raw("orders").count() // ROUNDS_A_PART), -(-self.raw("lineitem").count() // KILLS_A_PART))
        return parts_of(self.spark, self.dir, count)

    @cached_property
    def rounds(self) -> DataFrame:
        return self.by_match("rounds", self._rounds, ROUND_ORDER)

    def _rounds(self) -> DataFrame:
        key, cust = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
        c = cust % 10
        result = F.when(c < 5, "Elimination").when(c < 7, "Defuse").when(c == 7, "Detonate").when(c == 8, "Time").when(key % 26 >= 19, "Surrendered").otherwise("Elimination")
        planted = result.isin("Defuse", "Detonate") | (cust % 3 == 0)
        return self.raw("orders").select(
            key.alias("round_id"),
            div(key, 26).alias("match_id"),
            (key % 26 + 1).alias("round_number"),
            F.when(key % 101 != 100, F.concat(F.lit("Team "), F.when(cust % 2 == 0, "A").otherwise("B"), F.lit(" "), result, F.lit(" Win"))).alias("outcome"),
            planted.alias("planted"),
            F.when(planted, (20 + cust % 40).cast("double")).alias("plant_time"),
            (result == "Detonate").alias("exploded"),
            (result == "Defuse").alias("defused"),
            F.when(result == "Defuse", (27 + cust % 40 + key % 30).cast("double")).alias("defuse_time"),
            cust.alias("mix"),
        )

    @cached_property
    def matches(self) -> DataFrame:
        return self.by_match("matches", self._matches, ("match_id",))

    def _matches(self) -> DataFrame:
        m = F.col("match_id")
        seconds = F.lit(43200) * div(m, 4) + F.lit(3600) * (m % 4)
        return (
            self.rounds.groupBy("match_id")
            .agg(F.count_if(F.col("outcome").like("Team A%")).alias("team1_rounds_won"), F.count_if(F.col("outcome").like("Team B%")).alias("team2_rounds_won"))
            .select(
                "match_id",
                F.concat(F.lit("M"), m.cast("string")).alias("external_id"),
                F.concat(F.lit("Map"), ((5 * m + div(m, 11)) % 7).cast("string")).alias("map_name"),
                F.when(m % 37 != 36, F.timestamp_seconds(F.lit(1704067200) + seconds).cast("timestamp_ntz")).alias("played_at"),
                "team1_rounds_won",
                "team2_rounds_won",
            )
        )

    @cached_property
    def match_players(self) -> DataFrame:
        return self.by_match("match_players", self._match_players, PLAYER_ORDER)

    def _match_players(self) -> DataFrame:
        m, s = F.col("match_id"), F.col("slot")
        ours = F.when(m % 2 == 0, s < 5).otherwise(s >= 5)
        return (
            self.rounds.select("match_id")
            .distinct()
            .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
            .select(
                (10 * m + s).alias("match_player_id"),
                "match_id",
                "slot",
                F.when(ours, 5 * (div(m, 4) % 5) + s % 5 + 1).otherwise(31 + (11 * m + 3 * s) % 60).alias("player_id"),
                F.when(s < 5, TEAM_1).otherwise(TEAM_2).alias("team"),
                ((3 * m + 7 * s) % 29).alias("agent_no"),
            )
        )

    @cached_property
    def kill_events(self) -> DataFrame:
        """The feed; seq numbers a round's rows by time and then id."""
        return self.by_match("kill_events", self._kill_events, FEED_ORDER)

    def _kill_events(self) -> DataFrame:
        key, line = F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long")
        m = div(key, 26)
        supp, part = F.col("l_suppkey").cast("long"), F.col("l_partkey").cast("long")
        lines = self.raw("lineitem").select("*", key.alias("round_id"), m.alias("match_id")).repartition(self.parts, "match_id")  # without a number adaptive execution puts buckets together
        order = Window.partitionBy("match_id", "round_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        feed = lines.select(
            "round_id",
            "match_id",
            (F.col("round_id") * 1000 + F.row_number().over(order)).alias("kill_id"),
            F.when(supp % 19 != 18, 10 * F.col("match_id") + supp % 10).alias("killer"),
            (10 * F.col("match_id") + part % 10).alias("victim"),
            F.when(supp % 10 == part % 10, "Environmental").when(line % 7 == 0, "Bomb").otherwise(F.concat(F.lit("W"), F.col("l_returnflag"))).alias("weapon"),
            (2 * F.col("l_quantity").cast("double") + line / F.lit(4.0)).alias("t"),
        )
        return feed.withColumn("seq", F.row_number().over(Window.partitionBy("match_id", "round_id").orderBy("t", "kill_id")).cast("long"))

    @cached_property
    def stats(self) -> DataFrame:
        """A row for each round and player of its match; kills leave out self-kills."""
        return self.by_match("stats", self._stats, SEAT_ORDER)

    def _stats(self) -> DataFrame:
        grid = self.rounds.select("round_id", "match_id", "round_number", "mix").join(as_it_lies(self.match_players.select("match_id", "match_player_id", "slot", "team")), "match_id")
        who = lambda c, k, d: F.struct(F.col(c).alias("match_player_id"), k.alias("k"), d.alias("d"))
        none = F.lit(None).cast("int")
        both = F.explode(F.array(who("killer", F.when(F.col("killer") != F.col("victim"), 1), none), who("victim", none, F.lit(1)))).alias("p")
        deeds = (
            self.kill_events.select("match_id", "round_id", both)
            .where("p.match_player_id is not null")
            .groupBy("match_id", "round_id", "p.match_player_id")
            .agg(F.count("p.k").alias("kills"), F.count("p.d").alias("deaths"))
        )
        r, s, mix = F.col("round_id"), F.col("slot"), F.col("mix")
        kills = F.coalesce("kills", F.lit(0)).cast("long")
        return grid.join(as_it_lies(deeds), ["match_id", "round_id", "match_player_id"], "left").select(
            "round_id",
            "match_id",
            "round_number",
            "match_player_id",
            "team",
            (220 * kills + (13 * r + 29 * s) % 90).alias("score"),
            kills.alias("kills"),
            F.coalesce("deaths", F.lit(0)).cast("long").alias("deaths"),
            F.when((r + s) % 3 == 0, 1).otherwise(0).cast("long").alias("assists"),
            F.when(F.col("round_number").isin(1, 13), 800).otherwise((37 * mix + F.when(F.col("team") == TEAM_2, 1900).otherwise(0) + 150 * s) % 6000).cast("long").alias("loadout"),
            ((53 * mix + 577 * s) % 5000).alias("remaining"),
        )

    @cached_property
    def players(self) -> DataFrame:
        """A player per customer."""
        key = F.col("c_custkey").cast("long")
        return self.raw("customer").select(key.alias("player_id"), F.concat(F.lit("P"), key.cast("string"), F.lit("#T")).alias("display_name"))

    @cached_property
    def friendships(self) -> DataFrame:
        """Directed: owner and friend are regulars who were in one team, and (owner + friend) % 4 isn't 0. As many rows as regulars have teammates."""
        seat = self.match_players.where(F.col("player_id") <= REGULARS)
        own = seat.select("match_id", "team", F.col("player_id").alias("owner_id"))
        pairs = own.join(seat.select("match_id", "team", F.col("player_id").alias("friend_id")), ["match_id", "team"])
        return pairs.where("owner_id <> friend_id and (owner_id + friend_id) % 4 <> 0").select("owner_id", "friend_id").distinct()

    @cached_property
    def acts(self) -> DataFrame:
        """Acts of ACT_DAYS from the first day to the last match; the last one is open."""
        first = F.lit(FIRST_ACT).cast("timestamp_ntz")
        days = self.matches.agg(F.floor(F.datediff(F.max("played_at"), first) / ACT_DAYS).cast("int").alias("last"))
        rows = days.where("last is not null").select("last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
        start = lambda i: first + F.make_dt_interval(i * ACT_DAYS)
        end = F.when(F.col("i") < F.col("last"), start(F.col("i") + 1))
        return rows.select((F.col("i") + 1).cast("long").alias("act_id"), F.concat(F.lit("Act "), (F.col("i") + 1).cast("string")).alias("label"), start(F.col("i")).alias("act_start"), end.alias("act_end"))


#: The same tables as DuckDB common table expressions, for the SQL that queries are held against.
SQL = """
a_rounds AS (
    SELECT o_orderkey::BIGINT AS round_id, (o_orderkey // 26)::BIGINT AS match_id, (o_orderkey % 26 + 1)::BIGINT AS round_number,
        CASE WHEN o_orderkey % 101 <> 100 THEN 'Team ' || CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END || ' ' || result || ' Win' END AS outcome,
        planted, CASE WHEN planted THEN (20 + o_custkey % 40)::DOUBLE END AS plant_time, result = 'Detonate' AS exploded, result = 'Defuse' AS defused,
        CASE WHEN result = 'Defuse' THEN (27 + o_custkey % 40 + o_orderkey % 30)::DOUBLE END AS defuse_time, o_custkey::BIGINT AS mix
    FROM (SELECT *, result IN ('Defuse', 'Detonate') OR o_custkey % 3 = 0 AS planted FROM (
        SELECT *, CASE WHEN o_custkey % 10 < 5 THEN 'Elimination' WHEN o_custkey % 10 < 7 THEN 'Defuse' WHEN o_custkey % 10 = 7 THEN 'Detonate'
            WHEN o_custkey % 10 = 8 THEN 'Time' WHEN o_orderkey % 26 >= 19 THEN 'Surrendered' ELSE 'Elimination' END AS result FROM orders))
), a_matches AS (
    SELECT match_id, 'M' || match_id AS external_id, 'Map' || ((5 * match_id + match_id // 11) % 7) AS map_name,
        CASE WHEN match_id % 37 <> 36 THEN TIMESTAMP '2024-01-01' + to_seconds(43200 * (match_id // 4) + 3600 * (match_id % 4)) END AS played_at,
        count(*) FILTER (outcome LIKE 'Team A%') AS team1_rounds_won, count(*) FILTER (outcome LIKE 'Team B%') AS team2_rounds_won
    FROM a_rounds GROUP BY match_id
), a_match_players AS (
    SELECT 10 * match_id + slot AS match_player_id, match_id, slot,
        CASE WHEN (match_id % 2 = 0) = (slot < 5) THEN 5 * ((match_id // 4) % 5) + slot % 5 + 1 ELSE 31 + (11 * match_id + 3 * slot) % 60 END AS player_id,
        CASE WHEN slot < 5 THEN 'team-1' ELSE 'team-2' END AS team, (3 * match_id + 7 * slot) % 29 AS agent_no
    FROM (SELECT DISTINCT match_id FROM a_rounds), (SELECT unnest(range(0, 10)) AS slot)
), a_feed AS (
    SELECT l_orderkey::BIGINT AS round_id, (l_orderkey // 26)::BIGINT AS match_id,
        l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS kill_id,
        CASE WHEN l_suppkey % 19 <> 18 THEN 10 * (l_orderkey // 26) + l_suppkey % 10 END AS killer, 10 * (l_orderkey // 26) + l_partkey % 10 AS victim,
        CASE WHEN l_suppkey % 10 = l_partkey % 10 THEN 'Environmental' WHEN l_linenumber % 7 = 0 THEN 'Bomb' ELSE 'W' || l_returnflag END AS weapon,
        2 * l_quantity::DOUBLE + l_linenumber / 4.0::DOUBLE AS t
    FROM lineitem
), a_kills AS (
    SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY t, kill_id) AS seq FROM a_feed
), a_deeds AS (
    SELECT round_id, mp, sum(k)::BIGINT AS kills, sum(d)::BIGINT AS deaths FROM (
        SELECT round_id, killer AS mp, (killer <> victim)::INT AS k, 0 AS d FROM a_feed UNION ALL SELECT round_id, victim, 0, 1 FROM a_feed)
    WHERE mp IS NOT NULL GROUP BY ALL
), a_stats AS (
    SELECT r.round_id, r.match_id, r.round_number, p.match_player_id, p.team, 220 * coalesce(d.kills, 0) + (13 * r.round_id + 29 * p.slot) % 90 AS score,
        coalesce(d.kills, 0) AS kills, coalesce(d.deaths, 0) AS deaths, CASE WHEN (r.round_id + p.slot) % 3 = 0 THEN 1 ELSE 0 END AS assists,
        CASE WHEN r.round_number IN (1, 13) THEN 800 ELSE (37 * r.mix + CASE WHEN p.team = 'team-2' THEN 1900 ELSE 0 END + 150 * p.slot) % 6000 END AS loadout,
        (53 * r.mix + 577 * p.slot) % 5000 AS remaining
    FROM a_rounds r JOIN a_match_players p USING (match_id) LEFT JOIN a_deeds d ON d.round_id = r.round_id AND d.mp = p.match_player_id
), a_players AS (
    SELECT c_custkey::BIGINT AS player_id, 'P' || c_custkey || '#T' AS display_name FROM customer
), a_friends AS (
    SELECT DISTINCT a.player_id AS owner_id, b.player_id AS friend_id FROM a_match_players a JOIN a_match_players b ON a.match_id = b.match_id AND a.team = b.team AND a.player_id <> b.player_id
    WHERE a.player_id <= 25 AND b.player_id <= 25 AND (a.player_id + b.player_id) % 4 <> 0
), a_acts AS (
    SELECT i + 1 AS act_id, 'Act ' || (i + 1) AS label, TIMESTAMP '2024-01-01' + to_days((14 * i)::INTEGER) AS act_start, CASE WHEN i < n THEN TIMESTAMP '2024-01-01' + to_days((14 * i + 14)::INTEGER) END AS act_end
    FROM (SELECT n, unnest(range(n + 1)) AS i FROM (SELECT (max(played_at)::DATE - DATE '2024-01-01') // 14 AS n FROM a_matches))
), a_win AS (
    SELECT *, CASE WHEN outcome LIKE 'Team A%' THEN 'team-1' WHEN outcome LIKE 'Team B%' THEN 'team-2' END AS winner FROM a_rounds
)
"""
