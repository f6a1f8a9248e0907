"""Reading landed match documents and pages, and writing tables keyed by match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from .tables import written

_ATTRIBUTES = "struct<platformUserIdentifier:string,teamId:string,round:bigint,opponentPlatformUserIdentifier:string>"
_SEGMENT = f"struct<type:string,attributes:{_ATTRIBUTES},metadata:struct<agentName:string>,stats:map<string,double>,roundResult:string,winningTeam:string,weaponName:string,gameTime:bigint>"
DOCUMENT = f"attributes struct<id:string>, metadata struct<mapName:string,dateStarted:string,modeName:string>, segments array<{_SEGMENT}>"


def read_match_documents(spark: SparkSession, path: str) -> DataFrame:
    """Match documents, one JSON object a file or line, under a fixed schema; fields that a document lacks are null."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def normalise(documents: DataFrame) -> dict[str, DataFrame]:
    """matches, match_players, rounds, round_player_stats and kill_events of the documents, keyed by external_id.

    Segments split by their type. Surrendered rounds, and stats whose player or
    round is unknown, are left out; eliminations keep unknown players as nulls.
    """
    base = documents.select(F.col("attributes.id").alias("external_id"), "metadata", "segments").where("external_id is not null").dropDuplicates(["external_id"])
    seg = base.select("external_id", F.explode("segments").alias("s"))
    of = lambda kind: seg.where(F.col("s.type") == kind)
    a = "s.attributes."
    team = F.when(F.col(a + "teamId") == "Red", "team-1").otherwise("team-2")
    rounds = of("round-summary").where("s.roundResult <> 'Surrendered'").select(
        "external_id", F.col(a + "round").alias("round_number"), outcome(F.col("s.winningTeam"), F.col("s.roundResult")).alias("outcome"),
        F.col("s.stats")["plantTime"].alias("plant_time"), F.col("s.stats")["defuseTime"].alias("defuse_time"),
    )
    players = of("player-summary").select("external_id", F.col(a + "platformUserIdentifier").alias("display_name"), team.alias("team"), F.col("s.metadata.agentName").alias("agent"))
    stats = of("player-round").select("external_id", F.col(a + "round").alias("round_number"), F.col(a + "platformUserIdentifier").alias("display_name"), *[F.coalesce(F.col("s.stats")[k], F.lit(0.0)).cast("long").alias(k) for k in ("score", "kills", "deaths", "assists", "loadout", "remaining")])
    stats = stats.join(players.select("external_id", "display_name"), ["external_id", "display_name"], "left_semi").join(rounds.select("external_id", "round_number"), ["external_id", "round_number"], "left_semi")
    kills = of("player-round-kills").select(
        "external_id", F.col(a + "round").alias("round_number"), F.col(a + "platformUserIdentifier").alias("killer"), F.col(a + "opponentPlatformUserIdentifier").alias("victim"), F.coalesce("s.weaponName", F.lit("Unknown")).alias("weapon"), (F.col("s.gameTime") / 1000).alias("t"),
    ).join(rounds.select("external_id", "round_number"), ["external_id", "round_number"], "left_semi")
    won = of("team-summary").groupBy("external_id").agg(*[F.max(F.when(F.col(a + "teamId") == t, F.col("s.stats")["roundsWon"])).cast("long").alias(c) for t, c in (("Red", "team1_rounds_won"), ("Blue", "team2_rounds_won"))])
    matches = base.join(won, "external_id", "left").select("team1_rounds_won", "team2_rounds_won", "external_id", F.col("metadata.mapName").alias("map_name"), F.to_timestamp("metadata.dateStarted").alias("played_at"), F.col("metadata.modeName").alias("mode"))
    return {"matches": matches, "match_players": players, "rounds": rounds, "round_player_stats": stats, "kill_events": kills}


def outcome(winning_team: Column, result: Column) -> Column:
    return F.concat(F.lit("Team "), F.when(winning_team == "Red", "A").otherwise("B"), F.lit(" "), result, F.lit(" Win"))


def discover(history: DataFrame, known: DataFrame, mode: str = "Competitive") -> DataFrame:
    """Documents of the mode whose external_id isn't known yet, each once."""
    return history.where(F.col("mode") == mode).dropDuplicates(["external_id"]).join(known.select("external_id"), "external_id", "left_anti")


def most_recent(history: DataFrame, n: int, mode: str = "Competitive") -> DataFrame:
    """The ``n`` first documents of the mode in each player's history (player, place, external_id, mode), the most recent ones."""
    w = Window.partitionBy("player").orderBy("place")
    return history.where(F.col("mode") == mode).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def whole_history(history: DataFrame, acts: DataFrame, max_matches: int | None = None, max_acts: int | None = None, empty_acts: int = 3, mode: str = "Competitive") -> DataFrame:
    """(player, place, external_id) of all acts from the latest back, each document once, in order.

    ``history``: player, act_id, place, external_id, mode; ``acts``: act_id,
    act_start. The acts after ``empty_acts`` in a row without a document that is
    new are left out, as are those beyond ``max_acts``, and documents beyond ``max_matches``.
    """
    ranked = acts.select("act_id", F.row_number().over(Window.orderBy(F.desc("act_start"))).alias("act"))
    ranked = ranked if max_acts is None else ranked.where(F.col("act") <= max_acts)
    once = Window.partitionBy("player", "external_id").orderBy("act", "place")
    new = history.where(F.col("mode") == mode).join(ranked, "act_id").withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    counts = history.select("player").distinct().crossJoin(ranked.select("act")).join(new.groupBy("player", "act").agg(F.count("*").alias("n")), ["player", "act"], "left")
    back = Window.partitionBy("player").orderBy("act").rowsBetween(Window.unboundedPreceding, 0)
    streak = F.col("act") - F.coalesce(F.max(F.when(F.col("n") > 0, F.col("act"))).over(back), F.lit(0))
    stop = counts.withColumn("streak", streak).where(F.col("streak") >= empty_acts).groupBy("player").agg(F.min("act").alias("stop"))
    kept = new.join(stop, "player", "left").where("stop is null or act < stop")
    rows = kept.select("player", F.row_number().over(Window.partitionBy("player").orderBy("act", "place")).alias("place"), "external_id")
    return rows if max_matches is None else rows.where(F.col("place") <= max_matches)


def with_new_keys(dimension: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The dimension with a row for each new name, numbered on from the largest key. Names hash to partitions, so numbering is two small passes and no global sort."""
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(dimension.select(name), name, "left_anti").withColumn("_p", F.pmod(F.xxhash64(name), F.lit(64)))
    fresh = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(name)))
    sizes = {r["_p"]: r["n"] for r in fresh.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    start, offsets = dimension.agg(F.max(key)).first()[0] or 0, {}
    for p in sorted(sizes):
        offsets[p] = start
        start += sizes[p]
    if not offsets:
        return dimension
    table = F.create_map(*[F.lit(x) for p in offsets for x in (p, offsets[p])])
    return dimension.unionByName(fresh.select((table[F.col("_p")] + F.col("_i")).cast(dimension.schema[key].dataType).alias(key), name), allowMissingColumns=True)


def replace_matches(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """``table`` with all rows of the matches in ``fresh`` replaced by those of ``fresh``."""
    return table.join(fresh.select("external_id").distinct(), "external_id", "left_anti").unionByName(fresh)


def insert_matches(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """``table`` with the rows of ``fresh`` whose match it doesn't have."""
    return table.unionByName(fresh.join(table.select("external_id").distinct(), "external_id", "left_anti"))


#: Matches of a partition of a table written by match.
MATCHES_A_PART = 10_000


def upsert_by_match(df: DataFrame, path: str) -> None:
    """Put rows keyed by match_id into a Parquet table, partitioned by runs of matches: all rows that the table has of these matches are replaced.

    Only partitions with such matches are read and overwritten, so an update costs
    what its matches' partitions hold.
    """
    spark = df.sparkSession
    part = F.expr(f"match_id div {MATCHES_A_PART}").alias("part")
    fresh = df.select("*", part)
    try:
        held = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException:
        held = None
    if held is not None:
        touched = fresh.select("part").distinct()
        held = held.join(touched, "part", "left_semi").join(df.select("match_id").distinct(), "match_id", "left_anti")
        fresh = written(fresh.unionByName(held.select(*fresh.columns)), "upsert")
    fresh.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_snapshot(df: DataFrame, path: str, kind: str = "json") -> None:
    """A table as JSON, CSV with a header, or Parquet, one file a partition."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def impact_snapshot(impact: DataFrame, match_players: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """The impact rows with the names of their match and player, for write_snapshot."""
    rows = impact.join(match_players.select("match_id", "match_player_id", "player_id"), ["match_id", "match_player_id"]).join(matches.select("match_id", "external_id"), "match_id").join(players.select("player_id", "display_name"), "player_id")
    return rows.select(F.col("external_id").alias("match_external_id"), "round_number", "round_id", "match_player_id", F.col("display_name").alias("player_name"), "team", "kill_impact", "death_impact", "impact")


def read_impact_inserts(spark: SparkSession, path: str) -> DataFrame:
    """(round_id, match_player_id, kill_impact, death_impact, impact, breakdown) of the INSERT lines of a database dump; all other lines are passed over."""
    number = r"(-?[\d.]+)"
    line = rf"^INSERT INTO public\.impact_scores \([^)]*\) VALUES \(\d+, (\d+), (\d+), {number}, {number}, {number}, '(.*)'\);\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    breakdown = F.from_json(F.replace(part(6), F.lit("''"), F.lit("'")), "map<string,string>")
    return rows.select(*[part(i).cast("long").alias(c) for i, c in ((1, "round_id"), (2, "match_player_id"))], *[part(i).cast("double").alias(c) for i, c in ((3, "kill_impact"), (4, "death_impact"), (5, "impact"))], breakdown.alias("breakdown"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of ``key``."""
    reader = spark.read.format("jdbc").option("url", url.replace("postgres://", "postgresql://")).option("dbtable", table)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).options(**options).load()


# ---- strings of legacy pages and file names ---------------------------------------------------------------------------


def minutes_seconds(text: Column) -> Column:
    """Seconds of m:ss."""
    return F.split_part(text, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(text, F.lit(":"), F.lit(2)).cast("int")


def first_outcome(text: Column) -> Column:
    """The first round result in a text; null if there is none."""
    got = F.regexp_extract(text, "Team (A|B) (.{1,20}) Win", 0)
    return F.when(got != "", got)


def bar_loadout(pixels: Column) -> Column:
    """The loadout that a bar of so many pixels stands for."""
    return F.bround(pixels * 0.625 * 1000, 0).cast("long")


def thousands(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").cast("long")


def parse_file_names(df: DataFrame, name: str = "file", year: int = 2024) -> DataFrame:
    """``df`` with map_name and played_at from names like Split10241130: letters, then month, day and hour of one or two digits each and two digits of minutes.

    Where the digits can be cut in just one valid way the time is that (an
    afternoon hour); otherwise it is null.
    """
    stem = F.regexp_extract(name, "^([A-Za-z]+)([0-9]+)", 1)
    digits = F.regexp_extract(name, "^([A-Za-z]+)([0-9]+)", 2)
    cuts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (1, 2) for b in (1, 2) for c in (1, 2)])
    part = lambda start, n: F.substring(digits, start, n).cast("int")

    def as_time(x):
        m, d, h, mi = part(F.lit(1), x["a"]), part(1 + x["a"], x["b"]), part(1 + x["a"] + x["b"], x["c"]), part(1 + x["a"] + x["b"] + x["c"], F.lit(2))
        fits = (F.length(digits) == x["a"] + x["b"] + x["c"] + 2) & m.between(1, 12) & d.between(1, 31) & h.between(1, 12) & mi.between(0, 59)
        stamp = F.format_string("%04d-%02d-%02d %02d:%02d:00", F.lit(year), m, d, F.when(h == 12, 12).otherwise(h + 12), mi)
        return F.when(fits, stamp)

    found = F.array_distinct(F.filter(F.transform(cuts, lambda x: F.try_to_timestamp(as_time(x))), lambda t: t.isNotNull()))
    return df.withColumn("map_name", F.when(stem != "", stem)).withColumn("_found", found).withColumn("played_at", F.when(F.size("_found") == 1, F.col("_found")[0])).drop("_found")


def classify_icons(icons: DataFrame, references: DataFrame, most: int = 5) -> DataFrame:
    """(icon_id, label): the reference whose 64-bit hash differs in the fewest bits, the first label of equals; BAD CLASSIFICATION! beyond ``most``.

    Hashes that differ in at most ``most`` bits agree in one of ``most`` + 1 bands
    of bits, so an equi-join on bands finds them all; no icon meets every reference.
    """
    width = -(-64 // (most + 1))
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", k * width).bitwiseAND((1 << min(width, 64 - k * width)) - 1).alias("bits")) for k in range(most + 1)])).alias("b")
    mine = icons.select("icon_id", "hash", bands).select("icon_id", "hash", "b.*")
    known = references.select("hash", "label", bands).select(F.col("hash").alias("h"), "label", "b.*")
    near = mine.join(known, ["band", "bits"]).withColumn("d", F.bit_count(F.col("hash").bitwiseXOR(F.col("h")))).where(F.col("d") <= most)
    best = near.groupBy("icon_id").agg(F.min(F.struct("d", "label")).alias("b"))
    return icons.select("icon_id").join(best, "icon_id", "left").select("icon_id", F.coalesce("b.label", F.lit("BAD CLASSIFICATION!")).alias("label"))
