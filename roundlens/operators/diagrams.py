"""What diagrams and charts show: state deltas, the layout of the diamond, win colours, dense series and even rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The colours of a rate of 0 and of 1 (red, green, blue), and the steps, radius and padding of the two diagrams.
LOSS_COLOUR, WIN_COLOUR = (224, 85, 79), (12, 163, 12)
ROUND_WINS, KILL_ORDER = (56, 64, 28), (118, 134, 22)
PADDING = 36
TOP_DELTAS = 5


def win_colour(win_rate: Column) -> Column:
    """The colour between those of 0 and of 1, as #rrggbb; each part is rounded half to even."""
    parts = [F.bround(F.lit(float(a)) + F.lit(float(b - a)) * win_rate, 0).cast("int") for a, b in zip(LOSS_COLOUR, WIN_COLOUR, strict=True)]
    return F.format_string("#%02x%02x%02x", *parts)


def diamond_layout(spark: SparkSession, steps: tuple[int, int, int], lowest: int = 1) -> DataFrame:
    """(own, opp, x, y, width, height): where each state of own and opp from ``lowest`` to 5 stands, moved into a view that begins at 0.

    x grows with the own side's advantage, y with the players who have fallen;
    without ``lowest`` 1 the states in which one side is gone are there too.
    """
    x_step, y_step, radius = steps
    edge = radius + PADDING
    grid = spark.range(lowest, 6).select(F.col("id").alias("own")).withColumn("opp", F.explode(F.sequence(F.lit(lowest).cast("long"), F.lit(5).cast("long")))).where("own > 0 or opp > 0")
    x, y = (F.col("own") - F.col("opp")) * x_step / 2, (10 - F.col("own") - F.col("opp")) * F.lit(float(y_step))
    everywhere = Window.partitionBy()
    rows = grid.select("own", "opp", x.alias("x0"), y.alias("y0"))
    low, high = lambda c: F.min(c).over(everywhere), lambda c: F.max(c).over(everywhere)
    return rows.select("own", "opp", (F.col("x0") - low("x0") + edge).alias("x"), (F.col("y0") - low("y0") + edge).alias("y"), (high("x0") - low("x0") + 2 * edge).alias("width"), (high("y0") - low("y0") + 2 * edge).alias("height"))


def edge_lines(places: DataFrame, gap: float) -> DataFrame:
    """(own, opp, kind, x1, y1, x2, y2, mid_x, mid_y): lines from each state to that after a kill and a death, ``gap`` short at both ends, and their middles."""
    to = lambda kind, d_own, d_opp: places.select((F.col("own") + d_own).alias("own"), (F.col("opp") + d_opp).alias("opp"), F.lit(kind).alias("kind"), F.col("x").alias("x_to"), F.col("y").alias("y_to"))
    rows = places.where("own > 0 and opp > 0").join(to("kill", 0, 1).unionAll(to("death", 1, 0)), ["own", "opp"])
    dx, dy = F.col("x_to") - F.col("x"), F.col("y_to") - F.col("y")
    size = F.sqrt(dx * dx + dy * dy)
    ux, uy = F.coalesce(F.try_divide(dx, size), F.lit(0.0)) * gap, F.coalesce(F.try_divide(dy, size), F.lit(0.0)) * gap
    return rows.select("own", "opp", "kind", (F.col("x") + ux).alias("x1"), (F.col("y") + uy).alias("y1"), (F.col("x_to") - ux).alias("x2"), (F.col("y_to") - uy).alias("y2"), ((F.col("x") + F.col("x_to")) / 2).alias("mid_x"), ((F.col("y") + F.col("y_to")) / 2).alias("mid_y"))


def state_deltas(edges: DataFrame, by: str = "match_player_id") -> DataFrame:
    """(by, own, opp, delta): kills less deaths in each state; states where they are even tell nothing and are left out."""
    return edges.groupBy(by, "own", "opp").agg((F.sum("kills") - F.sum("deaths")).alias("delta")).where("delta <> 0")


def top_deltas(deltas: DataFrame, by: str = "match_player_id", n: int = TOP_DELTAS) -> DataFrame:
    """(by, gain, place, own, opp, delta): the largest gains and losses of each, the fewest own and then other players first among equals."""
    rows = deltas.withColumn("gain", F.col("delta") > 0)
    w = Window.partitionBy(by, "gain").orderBy(F.abs("delta").desc(), "own", "opp")
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n).select(by, "gain", "place", "own", "opp", "delta")


def player_series(impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """(match_id, match_player_id, data): a value for each round of the match in order, null where the player has none."""
    numbers = rounds.groupBy("match_id").agg(F.array_sort(F.collect_set("round_number")).alias("numbers"))
    held = impact.groupBy("match_id", "match_player_id").agg(F.map_from_entries(F.collect_list(F.struct("round_number", "impact"))).alias("m"))
    return held.join(numbers, "match_id").select("match_id", "match_player_id", F.transform("numbers", lambda r: F.element_at("m", r)).alias("data"))


def team_series(impact: DataFrame, rounds: DataFrame) -> DataFrame:
    """(match_id, team, data): a team's total for each round of the match in order, 0 where it has none."""
    numbers = rounds.groupBy("match_id").agg(F.array_sort(F.collect_set("round_number")).alias("numbers"))
    sums = impact.groupBy("match_id", "team", "round_number").agg(F.sum("impact").alias("impact"))
    held = sums.groupBy("match_id", "team").agg(F.map_from_entries(F.collect_list(F.struct("round_number", "impact"))).alias("m"))
    return held.join(numbers, "match_id").select("match_id", "team", F.transform("numbers", lambda r: F.coalesce(F.element_at("m", r), F.lit(0))).alias("data"))


def by_win_rate(groups: DataFrame, by: str, name: str) -> DataFrame:
    """``groups`` with place: the best win rate first, those without one last, then most matches, then the name."""
    w = Window.partitionBy(by).orderBy(F.coalesce("win_rate", F.lit(-1.0)).desc(), F.desc("matches"), name)
    return groups.withColumn("place", F.row_number().over(w).cast("long"))


def even_rows(items: DataFrame, by: str, order: str, most: int = 4) -> DataFrame:
    """``items`` with row and place in it: as few rows as hold ``most`` each, as even as can be, the longer ones first."""
    w = Window.partitionBy(by).orderBy(order)
    n, at = F.count("*").over(Window.partitionBy(by)), F.row_number().over(w) - 1
    rows = items.withColumn("_n", n).withColumn("_at", at).withColumn("_rows", F.ceil(F.col("_n") / most)).withColumn("_base", F.floor(F.col("_n") / F.col("_rows"))).withColumn("_more", F.col("_n") % F.col("_rows"))
    long = F.col("_more") * (F.col("_base") + 1)  # items in the longer rows
    row = F.when(F.col("_at") < long, F.floor(F.col("_at") / (F.col("_base") + 1))).otherwise(F.col("_more") + F.floor((F.col("_at") - long) / F.col("_base")))
    rows = rows.withColumn("row", row.cast("long"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by, "row").orderBy(order)).cast("long")).drop("_n", "_at", "_rows", "_base", "_more")


def exactly_one(df: DataFrame, what: str) -> DataFrame:
    """``df`` if it has one row; LookupError where it has none or more. Two rows at most are looked at."""
    found = df.limit(2).count()
    if found != 1:
        raise LookupError(f"{what}: {'none' if not found else 'more than one'}")
    return df
