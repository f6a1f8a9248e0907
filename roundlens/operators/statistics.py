"""Statistics over grouped rows: ranks, correlation, likelihoods, differences and cluster bootstraps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.scoring import r6


def average_ranks(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the rank of ``value`` in its group, equal values sharing their mean rank."""
    by = Window.partitionBy(group).orderBy(value)
    return df.withColumn(name, F.rank().over(by) + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2)


def spearman(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, rho) by squared differences of average ranks; groups of one row have none."""
    ranked = average_ranks(average_ranks(df, group, a, "_a"), group, b, "_b")
    n = F.count("*")
    return ranked.groupBy(group).agg(n.alias("n"), F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2))).alias("_d")).where("n > 1").select(group, "n", r6(1 - 6 * F.col("_d") / (F.col("n") * (F.pow("n", F.lit(2)) - 1))).alias("rho"))


def log_likelihood(hazard: DataFrame) -> DataFrame:
    """(ll_null, ll_gap): Bernoulli log-likelihoods of one rate for all gaps and of a rate for each, clamped off 0 and 1."""
    p0 = F.sum("chosen").over(Window.partitionBy()) / F.sum("offered").over(Window.partitionBy())
    rows = hazard.select("chosen", "offered", p0.alias("p0"), (F.col("chosen") / F.col("offered")).alias("p1"))
    clamp = lambda p: F.least(F.greatest(F.col(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    ll = lambda p: r6(F.sum(F.col("chosen") * F.log(clamp(p)) + (F.col("offered") - F.col("chosen")) * F.log(1 - clamp(p))))
    return rows.agg(ll("p0").alias("ll_null"), ll("p1").alias("ll_gap"))


def differences(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row: mean, mean size, median size and largest size of new - old."""
    d = F.col(new) - F.col(old)
    return df.agg(F.count("*").alias("n"), r6(F.avg(d)).alias("mean"), r6(F.avg(F.abs(d))).alias("mean_abs"), r6(F.percentile(F.abs(d), 0.5)).alias("median_abs"), F.max(F.abs(d)).alias("max_abs"))


#: A prime below 2^31, so that products of two residues are 64-bit numbers in any engine.
PRIME = 2147483647
#: How much of PRIME lies below each cumulated probability of a Poisson number of mean 1.
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def draw_weights(match_ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each match is in each draw (matches x draws): a Poisson number from a hash of seed, draw and match, whatever else is drawn.

    The hash takes fifth powers modulo PRIME, which are permutations, twice; SQL can repeat it.
    """
    power = lambda x: (lambda y: y * y % PRIME * x % PRIME)(x * x % PRIME)
    x = power((draws[None, :] * 48271 + match_ids[:, None] % PRIME * 69621 + seed) % PRIME)
    x = power((x + draws[None, :] * 16807 + 1) % PRIME)
    return np.searchsorted(np.array(POISSON), x, side="right")


def bootstrap_rates(blocks: DataFrame, draws: int = 200, seed: int = 12345, by: list[str] | None = None) -> DataFrame:
    """(``by``, low, high, defined): percentile interval of the kill rate of each cell when matches are weighted anew in each draw.

    ``blocks``: match_id, the ``by`` columns (own and opp, if not given), kills and
    deaths. A match's weights follow from its id alone, so each task adds up draws of
    the rows that it has, in exact numbers, and what leaves it is draws times cells;
    a scope may be all matches there are, and how they are dealt changes nothing.
    Draws without an elimination in a cell aren't defined there.
    """
    by = by or ["own", "opp"]
    numbers = np.arange(draws, dtype=np.int64)

    def partial(batches):
        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            cells = rows[by].drop_duplicates().reset_index(drop=True)
            cell = rows[by].merge(cells.reset_index(), on=by, how="left")["index"].to_numpy()
            ids, match = np.unique(rows["match_id"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(ids), len(cells), 2), np.int64)
            np.add.at(sums, (match, cell), rows[["kills", "deaths"]].to_numpy())
            drawn = np.tensordot(draw_weights(ids, numbers, seed), sums, axes=(0, 0))  # draws x cells x 2
            out = cells.loc[np.tile(np.arange(len(cells)), draws)].reset_index(drop=True)
            out["draw"], out["a"], out["b"] = np.repeat(numbers, len(cells)), drawn[..., 0].ravel(), drawn.sum(2).ravel()
            yield pa.RecordBatch.from_pandas(out[out["b"] > 0][[*by, "draw", "a", "b"]], schema=arrow, preserve_index=False)

    rows = blocks.where("match_id is not null").select(F.col("match_id").cast("long").alias("match_id"), *by, F.coalesce("kills", F.lit(0)).cast("long").alias("kills"), F.coalesce("deaths", F.lit(0)).cast("long").alias("deaths"))
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(c, T.LongType()) for c in ("draw", "a", "b")]])
    arrow = to_arrow_schema(schema)
    sums = rows.mapInArrow(partial, schema).groupBy(*by, "draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("p", F.col("a") / F.col("b"))
    return sums.groupBy(*by).agg(r6(F.percentile("p", 0.025)).alias("low"), r6(F.percentile("p", 0.975)).alias("high"), r6(F.count("*") / draws).alias("defined"))


#: Intervals need this share of defined draws and so many matches with duels of the player and of the teammates.
LEAST_DEFINED, LEAST_MATCHES = 0.5, 5
FIGHT_EV = (
    "player_id long, pool string, side string, own long, opp long, p_player double, n_player long, p_teammates double, n_teammates long, w_u double, w_d double, leverage double, m double, "
    "low double, high double, defined double, matches_player long, matches_teammates long, matches_w_u long, matches_w_d long, state string"
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.full(np.shape(whole), np.nan), where=np.asarray(whole) > 0)


COUNTS = ["entries", "wins", *[f"{p}_{c}" for p in ("player", "tracked", "all") for c in ("kills", "deaths")]]
SIDES = ("attack", "defend")
#: Where a cell's count lies among the sums that are kept: all of the states with both sides standing, entries and wins of those with one gone.
PLACE = {k: i for i, k in enumerate((side, own, opp, c) for side in SIDES for own in range(6) for opp in range(6) for c in range(len(COUNTS)) if own + opp and (own and opp or c < 2))}
#: Matches of a player whose draws are added up in one task.
MATCHES_A_BLOCK = 20_000


def _block_draws(sizes: np.ndarray, at: int, draws: int, seed: int, player: int) -> tuple[np.ndarray, np.random.Generator]:
    """(how many of each draw's picks fall in block ``at``, what picks within it).

    A draw takes as many matches as all blocks have, with replacement, so the numbers
    that fall in each block are multinomial: all blocks of a player tell the same ones.
    """
    first = np.random.default_rng([seed, player & 0xFFFFFFFF])
    if len(sizes) == 1:
        return np.full(draws, sizes[0]), first
    return first.multinomial(sizes.sum(), sizes / sizes.sum(), size=draws)[:, at], np.random.default_rng([seed, player & 0xFFFFFFFF, at + 1])


def _cells(player: int, drawn: np.ndarray, n: int, some: np.ndarray) -> list[tuple]:
    """FIGHT_EV of a player with ``n`` matches, whose sums as they are, and then of each draw, are ``drawn`` (in the order of PLACE); ``some``: matches that contribute to each rate, by side, own and opp."""
    draws = len(drawn) - 1

    def rail(side, a, b):
        """(rate of each draw, matches that contribute to it)."""
        if side == "attack" and b == 0 or side == "defend" and a == 0:
            return np.full(draws + 1, float(b == 0 and side == "attack")), n
        return _share(drawn[:, PLACE[side, a, b, 1]], drawn[:, PLACE[side, a, b, 0]]), int(some[SIDES.index(side), a, b, 3])

    out = []
    for pool, k in (("tracked", 4), ("all", 6)):
        for side in SIDES:
            for a in range(1, 6):
                for b in range(1, 6):
                    got = drawn[:, PLACE[side, a, b, 0] : PLACE[side, a, b, 0] + len(COUNTS)]
                    n_p, n_q = (int(some[SIDES.index(side), a, b, i]) for i in (0, k // 2 - 1))
                    fights, mates = got[:, 2] + got[:, 3], got[:, k] + got[:, k + 1]
                    p, q, (up, n_up), (down, n_down) = _share(got[:, 2], fights), _share(got[:, k], mates), rail(side, a, b - 1), rail(side, a - 1, b)
                    leverage = up - down
                    m = (p - q) * leverage
                    state, low, high, defined = "NO_DATA", None, None, None
                    if np.isfinite(m[0]):
                        state = "NON_POSITIVE_LEVERAGE"
                    if np.isfinite(m[0]) and leverage[0] > 0:
                        values = m[1:][np.isfinite(m[1:]) & (leverage[1:] > 0)]
                        defined = len(values) / draws
                        low, high = (float(x) for x in np.percentile(values, [2.5, 97.5])) if len(values) else (None, None)
                        sure = low is not None and defined >= LEAST_DEFINED and min(n_p, n_q) >= LEAST_MATCHES
                        state = "INTERVAL_NOT_ESTIMABLE" if not sure else "POSITIVE" if low > 0 else "NEGATIVE" if high < 0 else "UNRESOLVED"
                    known = lambda x: float(x) if np.isfinite(x) else None
                    value = known(m[0]) if leverage[0] > 0 else None
                    out.append((player, pool, side, a, b, known(p[0]), int(fights[0]), known(q[0]), int(mates[0]), known(up[0]), known(down[0]), known(leverage[0]) if state != "NO_DATA" else None, value, low, high, defined, n_p, n_q, n_up, n_down, state))
    return out


def fight_ev(wins: DataFrame, duels: DataFrame, match_players: DataFrame, draws: int = 2000, seed: int = 2, block: int = MATCHES_A_BLOCK) -> DataFrame:
    """FIGHT_EV of every player: m = (p_player - p_teammates) * (w_u - w_d) in each state of each side against both pools of teammates, with its bootstrap.

    Of player_fight_blocks. A draw takes as many of the player's matches as there
    are, with replacement, the same ones for all of the player's cells; it is
    defined where all rates are and the leverage is positive. A group is the sums
    per match and state of some ``block`` matches of a player; the sums of its draws are then
    added up by player, as they come.
    """
    seats = match_players.where("player_id is not null").select("player_id", "match_id").distinct()
    # broadcast: at most one row for ``block`` seats
    large = F.broadcast(seats.groupBy("player_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("player_id", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    state = F.when(F.col("side").isin(*SIDES) & F.col("own").between(0, 5) & F.col("opp").between(0, 5), F.when(F.col("side") == "attack", 0).otherwise(36) + 6 * F.col("own") + F.col("opp")).cast("int").alias("state")
    summed = lambda df: df.select("player_id", "match_id", state, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in df.columns else F.lit(0).cast("long").alias(c) for c in COUNTS]).where("state is not null")
    parts = [summed(wins), summed(duels), seats.select("*", F.lit(None).cast("int").alias("state"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])]
    small = [part.join(large, "player_id", "left_anti") for part in parts]
    placed = [part.join(large, "player_id").withColumn("block", F.pmod(F.hash("match_id"), "blocks")).drop("blocks") for part in parts]
    size = placed[2].groupBy("player_id", "block").agg(F.count("*").alias("n"))
    heads = size.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("all")).select("player_id", F.col("all.n").alias("sizes"), F.posexplode("all").alias("at", "one"))
    heads = heads.select("player_id", F.col("one.block").alias("block"), "sizes", "at")
    grid = len(SIDES) * 36
    used = [(36 * SIDES.index(side) + 6 * own + opp) * len(COUNTS) + c for side, own, opp, c in PLACE]

    def drawn_sums(rows: pd.DataFrame, sizes: list[int] | None, at: int, player: int) -> tuple[np.ndarray, int, np.ndarray]:
        """(sums of the matches as they are, and then of each draw; the number of matches; those that contribute to each rate) of a block's rows."""
        ids = np.unique(rows.loc[rows["state"].isna(), "match_id"].to_numpy(np.int64))
        n, seen = len(ids), rows[rows["state"].notna()]
        asked = seen["match_id"].to_numpy(np.int64)
        match = np.minimum(np.searchsorted(ids, asked), n - 1)
        here = ids[match] == asked
        cell = match[here] * grid + seen["state"].to_numpy(int)[here]
        held = np.stack([np.bincount(cell, seen[c].to_numpy(float)[here], n * grid).reshape(n, grid) for c in COUNTS], axis=2)
        some = np.stack([(held[:, :, k : k + w].sum(axis=2) > 0).sum(axis=0) for k, w in ((2, 2), (4, 2), (6, 2), (0, 1))], axis=1)  # duels of the player, of both pools of teammates, and entries
        flat = held.reshape(n, -1)[:, used]
        taken, rng = _block_draws(np.array([n] if sizes is None else sizes, np.int64), at, draws, seed, player)
        exact = np.float32 if taken.max() * flat.max(initial=0) < 2**24 else float  # whole numbers up to there are exact
        sums, narrow, step = [flat.sum(axis=0)[None]], flat.astype(exact), max(1, 4_000_000 // n)
        for lo in range(0, draws, step):
            k = taken[lo : lo + step]
            picks = rng.integers(0, n, size=k.sum()) + np.repeat(n * np.arange(len(k)), k)
            sums.append(np.bincount(picks, minlength=len(k) * n).reshape(len(k), n).astype(exact) @ narrow)
        return np.concatenate(sums).astype(np.int64), n, some

    names = [c.split()[0] for c in FIGHT_EV.split(", ")]

    def one_small(rows: pd.DataFrame) -> pd.DataFrame:
        player = int(rows["player_id"].iloc[0])
        drawn, n, some = drawn_sums(rows, None, 0, player)
        return pd.DataFrame(_cells(player, drawn, n, some.reshape(len(SIDES), 6, 6, 4)), columns=names)

    partial = T.StructType.fromDDL("player_id long, draw int, sums array<bigint>")
    arrow, told = to_arrow_schema(partial), to_arrow_schema(T.StructType.fromDDL(FIGHT_EV))

    def one_block(rows: pa.Table) -> pa.Table:
        player, is_head = rows.column("player_id")[0].as_py(), rows.column("at").is_valid()
        head = rows.filter(is_head).select(["sizes", "at"]).to_pylist()[0]
        drawn, n, some = drawn_sums(rows.filter(rows.column("at").is_null()).drop_columns(["sizes", "at"]).to_pandas(), head["sizes"], head["at"], player)
        ends = np.concatenate([np.arange(draws + 2) * len(used), [(draws + 1) * len(used) + 1 + some.size]])
        sums = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([drawn.ravel(), [n], some.ravel()]), pa.int64()), type=arrow.field("sums").type)
        return pa.Table.from_arrays([pa.array(np.full(draws + 2, player), pa.int64()), pa.array([*range(draws + 1), -1], pa.int32()), sums], schema=arrow)

    def one_player(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player, drawn, some = None, np.zeros((draws + 1, len(used)), np.int64), np.zeros(1 + grid * 4, np.int64)
        for batch in batches:
            player, draw = batch.column("player_id")[0].as_py(), batch.column("draw").to_numpy(zero_copy_only=False)
            values = lambda mine: batch.filter(pa.array(mine)).column("sums").flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            some += values(draw < 0).reshape(-1, len(some)).sum(axis=0)
            np.add.at(drawn, draw[draw >= 0], values(draw >= 0).reshape(-1, len(used)))
        cells = _cells(player, drawn, int(some[0]), some[1:].reshape(len(SIDES), 6, 6, 4))
        yield pa.RecordBatch.from_pandas(pd.DataFrame(cells, columns=names), schema=told, preserve_index=False)

    whole = lambda rows: rows[0].unionByName(rows[1]).unionByName(rows[2])
    sums = whole(placed).unionByName(heads, allowMissingColumns=True).groupBy("player_id", "block").applyInArrow(one_block, partial)
    return whole(small).groupBy("player_id").applyInPandas(one_small, FIGHT_EV).unionByName(sums.groupBy("player_id").applyInArrow(one_player, FIGHT_EV))
