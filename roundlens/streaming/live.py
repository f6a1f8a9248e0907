"""Matches as they land: each document once, scored in micro-batches, state in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.impact import keep_impact
from ..sources.ingest import DOCUMENT


def landed_documents(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """A stream of match documents from a folder, each external_id once within ``late``; state is dropped beyond it."""
    rows = spark.readStream.schema(DOCUMENT).json(path)
    rows = rows.withColumn("external_id", F.col("attributes.id")).withColumn("at", F.to_timestamp("metadata.dateStarted"))
    return rows.where("external_id is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["external_id"])


def score_as_they_land(documents: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each micro-batch to ``sink``, which must replace a match's rows by key so that a repeated batch does no harm."""
    return documents.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def impact_sink(path: str, tables: Callable[[], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A sink for score_as_they_land of rows with a match_id: the impact table at ``path`` is brought up to date for the matches of each batch.

    ``tables`` gives kill_events, rounds, match_players and stats as they are when the
    batch comes; a batch that is repeated computes the same rows again and replaces them.
    """

    def put(batch: DataFrame, number: int) -> None:
        now = tables()
        keep_impact(path, batch, now["kill_events"], now["rounds"], now["match_players"], now["stats"])

    return put


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n) over event time; rows later than ``late`` are left out in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
