"""Friends, shared rounds of a squad, and the assignment of shoutouts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import r6, rate
from .matching import best_assignment
from .summaries import with_result

SQUAD_ROUNDS, CANDIDATES, SCAVENGED_A_ROUND = 20, 5, 500

#: Counters that shoutouts are about, in order of priority.
MATCH_COUNTERS = "entry_kills clutches post_plant_kills multi_kill_rounds streak outnumbered_kills even_fight_kills kills_of_top late_kills sniper_kills eco_kills sugar scavenger traded_teammate traded_by_teammate mvps active_rounds".split()
PAIR_COUNTERS = "win_percent avg_impact clutches trades rounds kill_surplus sugar scavenger".split()
# Headline and text by counter; {v} is the value, {s} an s unless it is 1.
MATCH_TEXTS = """
Entry Fragger: {v} first blood{s}
Clutch Gene: {v} clutch round{s} won
Post-Plant Menace: {v} kill{s} defending the plant
Multi-Kill Machine: {v} round{s} with 3+ kills
On A Heater: a {v}-kill streak without dying
Round Changer: {v} kill{s} while outnumbered
Even-Fight Specialist: {v} kill{s} in even-numbered fights
Shut Down Their Star: {v} kill{s} on the enemy's top fragger
Closer: {v} kill{s} after the 1-minute mark
Worth The Credits: {v} kill{s} with the Operator
Does More With Less: {v} kill{s} on an eco/force buy
Sugar Daddy: gave away {v} credits worth of guns
Scavenger: salvaged {v} credits worth of gear
Avenger: traded for a teammate {v} time{s}
Never Alone: avenged by a teammate {v} time{s}
Round MVP: highest-Impact player in {v} round{s}
Most Active: {v} round{s} with a kill or assist
"""
PAIR_TEXTS = """
Best Duo: won {v}% of rounds together
Dynamic Duo: {v} avg round-win impact together
Clutch Partners: {v} clutch round{s} won together
Trade Partner: traded for each other {v} time{s}
Ride or Die: {v} round{s} played together
Lethal Combo: outkilled opponents by {v} combined, together
Sugar Daddy: gave away {v} credits worth of guns together
Scavenger: salvaged {v} credits worth of gear together
"""


def texts(counters: list[str], told: str) -> list[tuple[str, str, str]]:
    """(counter, headline, text) of each counter."""
    return [(c, *line.split(": ", 1)) for c, line in zip(counters, told.strip().splitlines(), strict=True)]


MATCH_CATEGORIES, SQUAD_CATEGORIES = texts(MATCH_COUNTERS, MATCH_TEXTS), texts(PAIR_COUNTERS, PAIR_TEXTS)
BEST_ROUND, NOTHING = ("Highlight Reel", " Impact in a single round"), ("UH OH", "no category fits")


def add_friends(friendships: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges with those of ``wanted`` added once; nobody befriends themselves."""
    return friendships.unionByName(wanted.where("owner_id <> friend_id")).distinct()


def remove_friends(friendships: DataFrame, gone: DataFrame) -> DataFrame:
    return friendships.join(gone, ["owner_id", "friend_id"], "left_anti")


def shared_rounds(impact: DataFrame, rounds: DataFrame, match_players: DataFrame, friendships: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A row per round that an owner and a friend of theirs played on one team: results of both.

    ``facts`` (match_id, round_id, match_player_id and more) add columns of the owner,
    and of the friend with friend_ before their names. The owner's and the friend's rows meet on match and
    round, so the join grows with rounds and friends, not with their squares.
    """
    rows = with_result(impact, rounds).join(match_players.select("match_id", "match_player_id", "player_id", "agent_no"), ["match_id", "match_player_id"])
    more = []
    if facts is not None:
        more = [c for c in facts.columns if c not in ("match_id", "round_id", "match_player_id")]
        rows = rows.join(facts, ["match_id", "round_id", "match_player_id"], "left")
    side = rows.select("match_id", "round_id", "team", "player_id", "agent_no", "won", "win_impact", "traded_teammate", "traded_by_teammate", *more)
    own = side.join(friendships, side.player_id == friendships.owner_id).drop("player_id")
    theirs = [F.col(c).alias(f"friend_{c}") for c in more]
    other = side.select("match_id", "round_id", "team", F.col("player_id").alias("friend_id"), F.col("win_impact").alias("friend_win_impact"), F.col("agent_no").alias("friend_agent"), F.col("traded_teammate").alias("friend_traded"), *theirs)
    return own.join(other, ["match_id", "round_id", "team", "friend_id"])


def pair_counters(shared: DataFrame) -> DataFrame:
    """Per owner and friend PAIR_COUNTERS, whole numbers, over shared_rounds with the facts kills, deaths, clutch (0 or 1), sugar and scavenger.

    A clutch of both counts once; a missing fact counts 0.
    """
    both = lambda c: F.coalesce(c, F.lit(0)) + F.coalesce(f"friend_{c}", F.lit(0))
    n = F.count("*")
    return shared.groupBy("owner_id", "friend_id").agg(
        F.bround(100 * F.count_if("won") / n, 0).cast("long").alias("win_percent"), F.bround(F.avg(F.col("win_impact") + F.col("friend_win_impact")), 0).cast("long").alias("avg_impact"),
        F.count_if(both("clutch") > 0).alias("clutches"), F.sum(F.col("traded_teammate") + F.col("friend_traded")).cast("long").alias("trades"), n.alias("rounds"),
        F.sum(both("kills") - both("deaths")).cast("long").alias("kill_surplus"), F.sum(both("sugar")).cast("long").alias("sugar"), F.sum(both("scavenger")).cast("long").alias("scavenger"),
    )


def stacked(wide: DataFrame, keys: list[str], categories: list[tuple[str, str, str]]) -> DataFrame:
    """(keys, category, priority, value) from a column per counter."""
    each = [F.struct(F.lit(c).alias("category"), F.lit(i).cast("long").alias("priority"), F.col(c).cast("long").alias("value")) for i, (c, _, _) in enumerate(categories)]
    return wide.select(*keys, F.explode(F.array(*each)).alias("c")).select(*keys, "c.*")


def squad(shared: DataFrame) -> DataFrame:
    """Per owner and friend: matches and rounds together, win rate, mean of both players' impact, trades."""
    w = F.count_if("won")
    return shared.groupBy("owner_id", "friend_id").agg(
        F.count_distinct("match_id").alias("matches"), F.count("*").alias("rounds"), r6(rate(w, F.count("*"))).alias("win_rate"),
        r6(F.avg(F.col("win_impact") + F.col("friend_win_impact"))).alias("avg_impact"), F.sum(F.col("traded_teammate") + F.col("friend_traded")).alias("trades"),
    )


def eligible(pairs: DataFrame) -> DataFrame:
    """Pairs with enough rounds together to be told about."""
    return pairs.where(F.col("rounds") >= SQUAD_ROUNDS)


def catalogue(spark: SparkSession, categories: list[tuple[str, str, str]] = MATCH_CATEGORIES) -> DataFrame:
    """(category, priority, headline, template)."""
    return spark.createDataFrame([(c, i, h, t) for i, (c, h, t) in enumerate(categories)], "category string, priority long, headline string, template string")


def eligible_values(values: DataFrame) -> DataFrame:
    """Of (..., category, value, matches, rounds) the values that are enough for their category: a sniper kill a match, and SCAVENGED_A_ROUND credits found a round."""
    enough = F.when(F.col("category") == "sniper_kills", F.col("value") >= F.col("matches")).when(F.col("category") == "scavenger", F.col("value") >= SCAVENGED_A_ROUND * F.col("rounds")).otherwise(F.lit(True))
    return values.where(enough).drop("matches", "rounds")


def candidates(values: DataFrame, top: int = CANDIDATES) -> DataFrame:
    """Of (scope_id, category, priority, player_id, name, value) the best ``top`` of each category with a value, rank 0 first."""
    w = Window.partitionBy("scope_id", "category").orderBy(F.desc("value"), "name", "player_id")
    return values.where("value > 0").withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < top)


ASSIGNED = "scope_id long, player_id long, category string, rank long"


def assign_shoutouts(found: DataFrame) -> DataFrame:
    """One category for as many players of a scope as possible (ASSIGNED), by least-cost matching: then the least sum of ranks, then the least worst rank.

    Of equals, the one that gives its categories, in order of priority, to the better ranks.
    """

    def assign(rows: pa.Table) -> pa.Table:
        scope, category, priority, player, rank = (column.to_pylist() for column in rows.columns)
        names = [c for _, c in sorted(set(zip(priority, category, strict=True)))]
        number = {c: i for i, c in enumerate(names)}
        ranks = {(p, number[c]): r for p, c, r in zip(player, category, rank, strict=True)}
        given = sorted(best_assignment(ranks).items())
        columns = [[scope[0]] * len(given), [p for p, _ in given], [names[c] for _, c in given], [ranks[x] for x in given]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["scope_id", "player_id", "category", "rank"])

    return found.select("scope_id", "category", "priority", "player_id", "rank").groupBy("scope_id").applyInArrow(assign, ASSIGNED)


def told_values(values: DataFrame, categories: list[tuple[str, str, str]] = MATCH_CATEGORIES) -> DataFrame:
    """(scope_id, player_id, headline, detail) of ``values`` (scope_id, player_id, category, value); the catalogue has a row per category and is broadcast."""
    s = F.when(F.col("value") == 1, "").otherwise("s")
    detail = F.replace(F.replace("template", F.lit("{v}"), F.col("value").cast("string")), F.lit("{s}"), s)
    return values.join(F.broadcast(catalogue(values.sparkSession, categories).drop("priority")), "category").select("scope_id", "player_id", "headline", detail.alias("detail"))


def told_shoutouts(roster: DataFrame, assigned: DataFrame, values: DataFrame, best_rounds: DataFrame, anchors: DataFrame | None = None, categories: list[tuple[str, str, str]] = MATCH_CATEGORIES) -> DataFrame:
    """(scope_id, player_id, headline, detail): one for every player of ``roster`` (scope_id, player_id).

    The assigned category with its ``values`` (scope_id, player_id, category,
    value); else the best round of the player (best_rounds: scope_id, player_id,
    impact), then the scope's anchor (scope_id, player_id, headline, detail), then NOTHING.
    """
    key = ["scope_id", "player_id"]
    given = told_values(assigned.join(values.select(*key, "category", "value"), [*key, "category"]), categories)
    rows = roster.select(*key).distinct().join(given, key, "left").join(best_rounds.select(*key, F.bround("impact", 0).cast("long").alias("best")), key, "left")
    if anchors is None:
        rows = rows.withColumn("a_headline", F.lit(None).cast("string")).withColumn("a_detail", F.lit(None).cast("string"))
    else:
        rows = rows.join(anchors.select(*key, F.col("headline").alias("a_headline"), F.col("detail").alias("a_detail")), key, "left")
    reel = F.when(F.col("best").isNotNull(), F.lit(BEST_ROUND[0]))
    return rows.select(*key, F.coalesce("headline", reel, "a_headline", F.lit(NOTHING[0])).alias("headline"), F.coalesce("detail", F.concat(F.col("best").cast("string"), F.lit(BEST_ROUND[1])), "a_detail", F.lit(NOTHING[1])).alias("detail"))
