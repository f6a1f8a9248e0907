"""Match documents of changing shape: kept as variants, read field by field with defaults.

A document's segments have fields that come, go and change their type from season to
season. They are parsed once into a VARIANT column, which Parquet stores shredded:
fields that most documents have lie in columns of their own, and readers of a few
fields read these alone. Nothing is dropped for being unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import outcome

#: Shredding of variants as they are written, with columns inferred from the rows.
SHRED = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true", "spark.sql.variant.allowReadingShredded": "true"}
STATS = ("score", "kills", "deaths", "assists", "loadout", "remaining")


def read_documents(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(file, doc) of JSON documents, one a file, or one a line if not ``whole``; what isn't JSON has a null doc."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def land_documents(documents: DataFrame, path: str) -> DataFrame:
    """Write documents as Parquet with shredded variants, and read them back."""
    spark = documents.sparkSession
    for key, value in SHRED.items():
        spark.conf.set(key, value)
    documents.write.mode("overwrite").parquet(path)
    return spark.read.schema(documents.schema).parquet(path)


def field(variant: str, path: str, kind: str, default: object = None) -> Column:
    """The field at ``path`` as ``kind``, whether it came as a number or a text, bare or as {"value": ..}; ``default`` where it is missing, null or something else."""
    bare, held = F.try_variant_get(variant, f"$.{path}", kind), F.try_variant_get(variant, f"$.{path}.value", kind)
    got = F.coalesce(held, bare)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """matches, match_players, match_teams, rounds, round_player_stats and kill_events of (doc), keyed by external_id, each document once.

    As ``ingest.normalise`` has them, and with what a fixed schema loses: teams keep all
    their statistics, and eliminations what is known of the weapon, as variants.
    """
    base = documents.select(field("doc", "attributes.id", "string").alias("external_id"), "doc").where("external_id is not null")
    base = base.groupBy("external_id").agg(F.first("doc").alias("doc"))
    seg = base.select("external_id", F.explode(F.try_variant_get("doc", "$.segments", "array<variant>")).alias("s"))
    seg = seg.withColumn("type", field("s", "type", "string"))
    of = lambda kind: seg.where(F.col("type") == kind)
    a = lambda name, kind="string": field("s", f"attributes.{name}", kind)
    stat = lambda name, kind="double", default=None: field("s", f"stats.{name}", kind, default)
    number, player = a("round", "long").alias("round_number"), a("platformUserIdentifier")
    team = F.when(a("teamId") == "Red", "team-1").otherwise("team-2").alias("team")
    result = F.coalesce(field("s", "roundResult", "string"), field("s", "metadata.roundResult", "string"))
    won = F.coalesce(field("s", "winningTeam", "string"), field("s", "metadata.winningTeam", "string"))
    rounds = of("round-summary").where(F.coalesce(result != "Surrendered", F.lit(True)))
    rounds = rounds.select("external_id", number, outcome(won, result).alias("outcome"), stat("plantTime").alias("plant_time"), stat("defuseTime").alias("defuse_time"))
    players = of("player-summary").select("external_id", player.alias("display_name"), team, field("s", "metadata.agentName", "string").alias("agent"))
    teams = of("team-summary").select("external_id", team, stat("roundsWon", "long", 0).alias("rounds_won"), F.try_variant_get("s", "$.stats", "variant").alias("stats"))
    stats = of("player-round").select("external_id", number, player.alias("display_name"), *[stat(k, "double", 0.0).cast("long").alias(k) for k in STATS])
    stats = stats.join(players.select("external_id", "display_name"), ["external_id", "display_name"], "left_semi").join(rounds.select("external_id", "round_number"), ["external_id", "round_number"], "left_semi")
    weapon = F.coalesce(field("s", "weaponName", "string"), field("s", "metadata.weaponName", "string"), F.lit("Unknown"))
    time = F.coalesce(field("s", "gameTime", "double"), field("s", "metadata.gameTime", "double")) / 1000
    kills = of("player-round-kills").select("external_id", number, player.alias("killer"), a("opponentPlatformUserIdentifier").alias("victim"), weapon.alias("weapon"), time.alias("t"), F.try_variant_get("s", "$.metadata", "variant").alias("more"))
    kills = kills.join(rounds.select("external_id", "round_number"), ["external_id", "round_number"], "left_semi")
    sums = teams.groupBy("external_id").agg(*[F.max(F.when(F.col("team") == t, F.col("rounds_won"))).alias(c) for t, c in (("team-1", "team1_rounds_won"), ("team-2", "team2_rounds_won"))])
    meta = lambda name: field("doc", f"metadata.{name}", "string")
    matches = base.select("external_id", meta("mapName").alias("map_name"), F.try_to_timestamp(meta("dateStarted")).alias("played_at"), meta("modeName").alias("mode")).join(sums, "external_id", "left")
    return {"matches": matches, "match_players": players, "match_teams": teams, "rounds": rounds, "round_player_stats": stats, "kill_events": kills}
