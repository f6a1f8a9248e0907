"""Queries that stream a feed through its live counters; each is held against the SQL of the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming import counters
from . import replay, scoring  # noqa: F401 (their SQL)
from .base import ORACLE, query


def _fed(a, build):
    rows = counters.feed_rows(a.kill_events, a.rounds, a.match_players, a.matches)
    return counters.streamed(a.spark, rows, build, f"{shared_folder(a.spark)}/live-{uuid.uuid4().hex}")


def live_counters(a):
    """The counters of all matches when they closed; matches last some hours, and the feed's files come in no order."""
    return a.kept("live_counters", lambda: _fed(a, lambda feed: counters.live_counters(feed, "1000 days", 3_600_000).where("closed and match_id >= 0")))


query("l_live_streaks")(lambda a: live_counters(a).where("kind = 'streak'").select("match_player_id", "streak"))
query("l_live_clutches")(lambda a: live_counters(a).where("kind = 'clutch'").select("match_id", "round_id", "team", "own", "opp", "seq"))
query("l_live_trades")(lambda a: _fed(a, lambda feed: counters.live_trades(feed, "1000 days")).where(F.col("match_id") >= 0).select("round_id", "kill_id", "traded", "trader"))
ORACLE.update({"l_live_streaks": ORACLE["g4_streaks"], "l_live_clutches": ORACLE["g4_clutches"], "l_live_trades": ORACLE["c9_trades"]})
