"""Joins of points in time with the spans that hold them, by bins of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_DAYS = 7


def _bin(at: Column, days: int) -> Column:
    return F.floor(F.datediff(at, F.lit("1970-01-01").cast("date")) / days)


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, days: int = BIN_DAYS) -> DataFrame:
    """``points`` with the ``spans`` whose [start, end) holds ``at``; an ``end`` of null is open.

    Each span is repeated for each bin of ``days`` that it touches, up to the bin of the
    last point, and meets the points of that bin by equality; the bounds are tested on
    what meets. A point lies in one bin, so nothing comes twice. Points without a
    time and spans without a start join with nothing. The work grows with points
    times the spans over a bin, and a span's copies with its length in bins.
    """
    last = points.agg(F.max(at)).first()[0]
    if last is None:
        return points.join(spans, F.lit(False))
    stop = F.least(F.coalesce(F.col(end), F.lit(last)), F.lit(last))
    cut = spans.where(F.col(start).isNotNull() & (F.col(start) <= F.lit(last)) & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    cut = cut.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), days), _bin(stop, days))))
    met = points.withColumn("_bin", _bin(F.col(at), days)).join(cut, "_bin")
    return met.where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_bin")
