"""Checks of observed win rates that needn't hold but are worth a look, and the report of them; comparisons of two versions of impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import r6, rate
from ..sources.tables import as_it_lies
from .statistics import LEAST_DEFINED, LEAST_MATCHES

COMPLEMENT_MOST, CLOSURE_MOST, UNSTABLE_LEVERAGE, MOVERS = 0.15, 0.15, 0.05, 15
KEY = ["player_id", "side", "own", "opp"]


def win_rates(wins: DataFrame) -> DataFrame:
    """(player_id, side, own, opp, w, entries) of states from 0 to 5; where a side has won or lost by definition w says so, and entries is null."""
    w = wins.groupBy(*KEY).agg(F.sum("entries").alias("entries"), F.sum("wins").alias("wins"))
    six = F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))
    grid = wins.select("player_id").distinct().withColumn("side", F.explode(F.array(F.lit("attack"), F.lit("defend")))).withColumn("own", F.explode(six)).withColumn("opp", F.explode(six))
    rows = grid.join(w, KEY, "left")
    sure = F.when((F.col("side") == "attack") & (F.col("opp") == 0), 1.0).when((F.col("side") == "defend") & (F.col("own") == 0), 0.0)
    return rows.select(*KEY, F.coalesce(sure, rate(F.col("wins"), F.col("entries"))).alias("w"), F.when(sure.isNull(), F.col("entries")).alias("entries"))


def monotonicity(rates: DataFrame) -> DataFrame:
    """(player_id, side, own, opp, kind, w, w_next): states from which one more own player lowers the win rate (own), or one more opponent raises it (opp)."""
    here = rates.where("w is not null")
    own = here.join(here.select("player_id", "side", (F.col("own") - 1).alias("own"), "opp", F.col("w").alias("w_next")), KEY).where("w_next < w").withColumn("kind", F.lit("own"))
    opp = here.join(here.select("player_id", "side", "own", (F.col("opp") - 1).alias("opp"), F.col("w").alias("w_next")), KEY).where("w_next > w").withColumn("kind", F.lit("opp"))
    return own.unionByName(opp).select(*KEY, "kind", r6(F.col("w")).alias("w"), r6(F.col("w_next")).alias("w_next"))


def boundaries(rates: DataFrame) -> DataFrame:
    """(player_id, side, own, opp, w, entries) of the states with one side gone whose rates are counted: attackers gone, or opponents of the defenders."""
    return rates.where("(side = 'attack' and own = 0 and opp > 0) or (side = 'defend' and opp = 0 and own > 0)").select(*KEY, r6(F.col("w")).alias("w"), F.coalesce("entries", F.lit(0)).alias("entries"))


def complements(rates: DataFrame) -> DataFrame:
    """(player_id, own, opp, w_attack, w_defend, diff): states whose rate in attack is further than COMPLEMENT_MOST from what the mirrored one in defence leaves."""
    a = rates.where("side = 'attack' and own > 0 and opp > 0 and w is not null").select("player_id", "own", "opp", F.col("w").alias("a"))
    d = rates.where("side = 'defend' and own > 0 and opp > 0 and w is not null").select("player_id", F.col("opp").alias("own"), F.col("own").alias("opp"), F.col("w").alias("d"))
    diff = F.abs(F.col("a") - (1 - F.col("d")))
    return a.join(d, ["player_id", "own", "opp"]).where(r6(diff) > COMPLEMENT_MOST).select("player_id", "own", "opp", r6(F.col("a")).alias("w_attack"), r6(F.col("d")).alias("w_defend"), r6(diff).alias("diff"))


def closures(rates: DataFrame, duels: DataFrame) -> DataFrame:
    """(player_id, side, own, opp, leverage, p_star, p_team, diff, unstable): where the kill rate of the whole team isn't near the one that the win rates imply, or leverage is too small to tell."""
    team = duels.groupBy(*KEY).agg(F.sum(F.col("player_kills") + F.col("all_kills")).alias("k"), F.sum(F.col("player_deaths") + F.col("all_deaths")).alias("d")).where("k + d > 0")
    w = rates.select(*KEY, "w").where("w is not null")
    up, down = w.select("player_id", "side", "own", (F.col("opp") + 1).alias("opp"), F.col("w").alias("u")), w.select("player_id", "side", (F.col("own") + 1).alias("own"), "opp", F.col("w").alias("v"))
    rows = w.where("own > 0 and opp > 0").join(up, KEY).join(down, KEY).join(team, KEY).withColumn("leverage", F.col("u") - F.col("v")).where("leverage <> 0")
    star, p = (F.col("w") - F.col("v")) / F.col("leverage"), rate(F.col("k"), F.col("k") + F.col("d"))
    rows = rows.select(*KEY, r6(F.col("leverage")).alias("leverage"), r6(star).alias("p_star"), r6(p).alias("p_team"), r6(F.abs(star - p)).alias("diff"))
    rows = rows.withColumn("unstable", F.abs("leverage") < UNSTABLE_LEVERAGE)
    return rows.where(F.col("unstable") | (F.col("diff") > CLOSURE_MOST))


def reconstruction(duels: DataFrame) -> DataFrame:
    """(player_id, side, own, opp, kills, deaths) of the player and all teammates together, which is the team's."""
    return duels.groupBy(*KEY).agg(F.sum(F.col("player_kills") + F.col("all_kills")).alias("kills"), F.sum(F.col("player_deaths") + F.col("all_deaths")).alias("deaths"))


SECTIONS = {
    "cells": "pool string, side string, own long, opp long, state string, p_player double, n_player long, p_teammates double, n_teammates long, w_u double, w_d double, leverage double, m double, low double, high double, defined double, matches_player long, matches_teammates long, matches_w_u long, matches_w_d long",
    "monotonicity": "side string, own long, opp long, kind string, w double, w_next double",
    "boundaries": "side string, own long, opp long, w double, entries long",
    "complements": "own long, opp long, w_attack double, w_defend double, diff double",
    "closures": "side string, own long, opp long, leverage double, p_star double, p_team double, diff double, unstable boolean",
    "reconstruction": "side string, own long, opp long, kills long, deaths long",
    "excluded_rounds": "reason string, n long",
}
#: The report's JSON, for readers that want it as columns again.
REPORT = "player_id bigint, matches_considered bigint, accepted_rounds bigint, thresholds struct<least_defined:double,least_matches:bigint,complement_most:double,closure_most:double,unstable_leverage:double>, " + ", ".join(
    f"{name} array<struct<{', '.join(c.replace(' ', ':') for c in columns.split(', '))}>>" for name, columns in SECTIONS.items()
)


def report(wins: DataFrame, duels: DataFrame, cells: DataFrame, diagnostics: DataFrame, match_players: DataFrame) -> DataFrame:
    """(player_id, report): the whole validation of a player as one JSON text (REPORT); a player has some hundred rows of it.

    ``cells`` are those of statistics.fight_ev with their intervals, ``diagnostics``
    those of replay.canonical_replay: the rounds of the player's matches that could be
    replayed, and why others couldn't. Thresholds stand beside what they decide.
    """
    rates = win_rates(wins)
    rounds = match_players.where("player_id is not null").select("player_id", "match_id").distinct().join(diagnostics.select("match_id", "reason"), "match_id")
    frames = {
        "cells": cells, "monotonicity": monotonicity(rates), "boundaries": boundaries(rates), "complements": complements(rates), "closures": closures(rates, duels), "reconstruction": reconstruction(duels),
        "excluded_rounds": rounds.where("reason is not null").groupBy("player_id", "reason").agg(F.count("*").alias("n")),
    }
    base = rounds.groupBy("player_id").agg(F.count_distinct("match_id").alias("matches_considered"), F.count_if(F.col("reason").isNull()).alias("accepted_rounds"))
    fixed = {"least_defined": LEAST_DEFINED, "least_matches": LEAST_MATCHES, "complement_most": COMPLEMENT_MOST, "closure_most": CLOSURE_MOST, "unstable_leverage": UNSTABLE_LEVERAGE}
    base = base.withColumn("thresholds", F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()]))
    for name, df in frames.items():
        columns = [c.split() for c in SECTIONS[name].split(", ")]
        rows = df.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in columns]))).alias(name))
        base = base.join(rows, "player_id", "left")
    filled = [F.coalesce(n, F.array().cast(base.schema[n].dataType)).alias(n) for n in SECTIONS]
    return base.select("player_id", F.to_json(F.struct("player_id", "matches_considered", "accepted_rounds", "thresholds", *filled)).alias("report"))


# ---- two versions of impact --------------------------------------------------------------------------------------------


def compared(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """Rows (match_id, round_id, match_player_id) of both versions with old_, new_ and delta_ of each value."""
    key = ["match_id", "round_id", "match_player_id"]
    rows = old.select(*key, *[F.col(v).alias(f"old_{v}") for v in values]).join(as_it_lies(new.select(*key, *[F.col(v).alias(f"new_{v}") for v in values])), key)
    return rows.select("*", *[(F.col(f"new_{v}") - F.col(f"old_{v}")).alias(f"delta_{v}") for v in values])


def coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """(match_id, both, retired, added): rows of a match in both versions, only in the old one, and only in the new one."""
    key = ["match_id", "round_id", "match_player_id"]
    rows = old.select(*key, F.lit(True).alias("o")).join(as_it_lies(new.select(*key, F.lit(True).alias("n"))), key, "full")
    o, n = F.col("o").isNotNull(), F.col("n").isNotNull()
    return rows.groupBy("match_id").agg(F.count_if(o & n).alias("both"), F.count_if(o & ~n).alias("retired"), F.count_if(~o & n).alias("added"))


def biggest_movers(rows: DataFrame, value: str = "impact", n: int = MOVERS) -> DataFrame:
    """The ``n`` rows that moved furthest, the lowest ids of equals first, with their place."""
    d = F.abs(f"delta_{value}")
    top = rows.orderBy(d.desc(), "round_id", "match_player_id").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(d.desc(), "round_id", "match_player_id")).cast("long"))


def moves_by_player(rows: DataFrame, match_players: DataFrame, value: str = "impact") -> DataFrame:
    """(player_id, n, mean): how far each player moved on average."""
    seats = match_players.select("match_id", "match_player_id", "player_id")
    return rows.join(as_it_lies(seats), ["match_id", "match_player_id"]).groupBy("player_id").agg(F.count("*").alias("n"), r6(F.avg(f"delta_{value}")).alias("mean"))


def moves_by_part(rows: DataFrame, parts: list[str]) -> DataFrame:
    """(part, mean): how far each part moved on average."""
    means = rows.agg(*[r6(F.avg(f"delta_{p}")).alias(p) for p in parts])
    return means.unpivot([], parts, "part", "mean")


def part_names(old: DataFrame, new: DataFrame, column: str = "breakdown") -> DataFrame:
    """(part, kept): parts of the breakdown maps in both versions (kept), only the old one (retired) or only the new one (added)."""
    keys = lambda df, name: df.select(F.explode(F.map_keys(column)).alias("part")).distinct().withColumn(name, F.lit(True))
    both = keys(old, "o").join(keys(new, "n"), "part", "full")
    return both.select("part", F.when(F.col("o") & F.col("n"), "kept").when(F.col("o"), "retired").otherwise("added").alias("state"))
