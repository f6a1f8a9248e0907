"""Counters of running matches: state by match that a timer closes, and trades by sessions of a round's feed.

A live feed is a stream of rows (FEED): eliminations, and rows without a kill_id that
tell who won a round. Its rows come in any order within the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scoring import TEAM_1, TEAM_2, TRADE_SECONDS, winner
from ..operators.impact import with_teams

FEED = "match_id long, at timestamp, round_id long, round_number long, kill_id long, t double, killer long, victim long, killer_team string, victim_team string, winner string, size_1 long, size_2 long"
COUNTED = "match_id long, kind string, closed boolean, match_player_id long, streak long, round_id long, team string, own long, opp long, seq long"
#: What is kept of an elimination.
EVENT = ("round_id", "round_number", "t", "killer", "victim", "victim_team")
#: When a match without a time is taken to have been.
NO_TIME = "2024-01-01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_KEY = "spark.sql.streaming.stateStore.providerClass"


def feed_rows(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, matches: DataFrame, round_seconds: int = 120) -> DataFrame:
    """FEED of match tables: what a live feed of them would have sent, a round starting ``round_seconds`` after the one before."""
    teams = with_teams(feed.drop("seq"), match_players)
    size = match_players.groupBy("match_id").agg(F.count_if(F.col("team") == TEAM_1).alias("size_1"), F.count_if(F.col("team") == TEAM_2).alias("size_2"))
    start = matches.select("match_id", F.coalesce("played_at", F.lit(NO_TIME).cast("timestamp_ntz")).cast("timestamp").alias("began"))
    info = rounds.select("match_id", "round_id", "round_number", winner(F.col("outcome")).alias("winner"))
    kills = info.drop("winner").join(teams.select("match_id", "round_id", "kill_id", "t", "killer", "victim", "killer_team", "victim_team"), ["match_id", "round_id"])
    ends = info.withColumn("t", F.lit(float(round_seconds)))
    rows = kills.unionByName(ends, allowMissingColumns=True).join(size, "match_id").join(start, "match_id")
    seconds = (F.col("round_number") - 1) * round_seconds + F.col("t")
    at = F.timestamp_micros((F.unix_micros("began") + seconds * 1_000_000).cast("long"))
    return rows.withColumn("at", at).select(*[c.split()[0] for c in FEED.split(", ")])


def count_match(events: list[dict], winners: dict[int, str], size_1: int, size_2: int) -> tuple[dict[int, int], list[tuple]]:
    """Longest streak of each player, and (round_id, team, own, opp, seq) of the clutches, of one match's ``events`` so far: a few hundred rows."""
    streak: dict[int, int] = {}
    run: dict[int, int] = {}
    clutches = []
    by_round: dict[tuple, list[dict]] = {}
    for e in events:
        by_round.setdefault((e["round_number"], e["round_id"]), []).append(e)
    for (number, round_id), rows in sorted(by_round.items()):
        left, fallen, best = {TEAM_1: size_1, TEAM_2: size_2}, set(), None
        side = winners.get(number)
        for seq, e in enumerate(sorted(rows, key=lambda e: (e["t"], e["kill_id"])), 1):
            if seq > 1 and not (left[TEAM_1] > 0 and left[TEAM_2] > 0):
                break
            killer, victim, team = e["killer"], e["victim"], e["victim_team"]
            if victim is not None and victim not in fallen:
                fallen.add(victim)
                if team in left:
                    left[team] -= 1
            if killer is not None:
                run[killer] = run.get(killer, 0) + 1
                streak[killer] = max(streak.get(killer, 0), run[killer])
            if victim is not None:
                streak.setdefault(victim, 0)
                run[victim] = 0
            if side is not None:
                own, opp = left[side], left[TEAM_1 if side == TEAM_2 else TEAM_2]
                if own in (1, 2) and opp >= own:
                    state = (own, seq, opp)
                    best = state if best is None else min(best, state)
        if best is not None:
            clutches.append((round_id, side, best[0], best[2], best[1]))
    return streak, clutches


def _milliseconds(at: pd.Series) -> pd.Series:
    """Event times as milliseconds; they may come as such, because pandas' nanoseconds end in 2262."""
    return at.map(lambda x: int(x.timestamp() * 1000)) if pd.api.types.is_datetime64_any_dtype(at) else at.astype("int64")


class MatchCounters(StatefulProcessor):
    """Keeps the events of open matches by kill_id, so that repeated rows do no harm, and the winners of their rounds; tells the counters of a match so far with each batch that has rows of it, and for good when the match has been still for ``still_ms`` of event time.

    A key may stand for several matches. Their state is one value that a batch reads and
    writes once, and one timer is set, for the match that is to close first. Rows
    behind the watermark are left out, unless their match is still open.
    """

    def __init__(self, still_ms: int):
        self.still_ms = still_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("matches", "held string")

    def _matches(self) -> dict[str, list]:
        """[size_1, size_2, last_ms, events by kill_id, winners by round_number] by match_id."""
        return json.loads(self.open.get()[0]) if self.open.exists() else {}

    def _due(self, matches: dict[str, list]) -> int | None:
        return min(m[2] for m in matches.values()) + self.still_ms if matches else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        some = lambda x: None if x is None or x != x else int(x)
        text = lambda x: x if isinstance(x, str) else None
        matches = self._matches()
        before, running, seen = self._due(matches), set(matches), set()
        passed = timerValues.getCurrentWatermarkInMs() if timerValues is not None else None
        for frame in rows:
            if not len(frame):
                continue
            columns = [frame[c].tolist() for c in ("match_id", "size_1", "size_2", "kill_id", *EVENT, "winner")]
            for match, size_1, size_2, kill, round_id, number, t, killer, victim, team, won, at in zip(*columns, _milliseconds(frame["at"]).tolist(), strict=True):
                one = str(int(match))
                if passed is not None and at <= passed and one not in running:
                    continue
                seen.add(one)
                held = matches.setdefault(one, [0, 0, 0, {}, {}])
                held[0], held[1], held[2] = int(size_1), int(size_2), max(held[2], at)
                if some(kill) is not None:
                    held[3][str(int(kill))] = [int(round_id), int(number), float(t), some(killer), some(victim), text(team)]
                elif text(won) is not None:
                    held[4][str(int(number))] = won
        if not seen:
            return
        self._keep(matches, before)
        yield self._told(False, {m: matches[m] for m in seen})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        matches = self._matches()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        closed = {m: held for m, held in matches.items() if held[2] + self.still_ms <= until}
        self._keep({m: held for m, held in matches.items() if m not in closed}, None)
        if closed:
            yield self._told(True, closed)

    def _keep(self, matches: dict[str, list], timer: int | None) -> None:
        """Write the state; ``timer`` is the one that is set."""
        due = self._due(matches)
        if matches:
            self.open.update((json.dumps(matches, separators=(",", ":")),))
        else:
            self.open.clear()
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)

    def _told(self, closed: bool, matches: dict[str, list]) -> pd.DataFrame:
        rows = []
        for match, (size_1, size_2, _, events, winners) in matches.items():
            streak, clutches = count_match([{"kill_id": int(k), **dict(zip(EVENT, v, strict=True))} for k, v in events.items()], {int(k): v for k, v in winners.items()}, size_1, size_2)
            rows += [(int(match), "streak", closed, p, n, None, None, None, None, None) for p, n in sorted(streak.items())]
            rows += [(int(match), "clutch", closed, None, None, *c) for c in clutches]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTED.split(", "))
        return pd.DataFrame({c.split()[0]: pd.array(list(v), "Int64") if c.endswith(" long") else list(v) for c, v in zip(COUNTED.split(", "), columns, strict=True)})


#: Matches whose open state is one value: a call of Python and of the state store is made for so many at a time.
MATCHES_A_STATE = 64


def live_counters(feed: DataFrame, late: str = "10 minutes", still_ms: int = 600_000) -> DataFrame:
    """COUNTED of a FEED stream: streaks and clutches of each match so far with each batch that has rows of it (closed false), and once for good (closed true) when nothing has come for ``still_ms`` of event time.

    Rows later than ``late`` are left out, unless their match is still open. State is the
    rows of open matches, and goes when they close. Event times may be of any year.
    """
    feed.sparkSession.conf.set(STATE_KEY, ROCKS)
    rows = feed.withWatermark("at", late).select(F.floor(F.col("match_id") / MATCHES_A_STATE).alias("matches"), "match_id", "kill_id", *EVENT, "winner", "size_1", "size_2", F.unix_millis("at").alias("at"))
    return rows.groupBy("matches").transformWithStateInPandas(MatchCounters(still_ms), COUNTED, "Append", "EventTime")


def live_trades(feed: DataFrame, late: str = "1 minute") -> DataFrame:
    """(match_id, round_id, kill_id, traded, trader) of a FEED stream: eliminations answered within TRADE_SECONDS by a teammate of the victim, the first answer each, once no earlier one can come.

    Eliminations of a round that lie closer together than a second more than
    TRADE_SECONDS are a session behind a watermark of ``late``: an elimination and its
    answers are in one, state is a session's rows, and each is kept once. Rows whose
    session would have ended before the watermark are left out; repeated rows count once.
    """
    feed.sparkSession.conf.set(STATE_KEY, ROCKS)  # the other store keeps all state on the heap
    rows = feed.withWatermark("at", late).where("kill_id is not null and killer is not null and killer <> victim")
    event = F.struct("t", "kill_id", "killer", "victim", "killer_team", "victim_team", "at")
    held = rows.groupBy("match_id", "round_id", F.session_window("at", f"{TRADE_SECONDS + 1} seconds").alias("_span")).agg(F.collect_set(event).alias("_all"))
    soon = F.expr(f"interval {TRADE_SECONDS} seconds")

    def answered(one: Column) -> Column:
        answers = F.filter("_all", lambda x: (x["victim"] == one["killer"]) & (x["killer_team"] == one["victim_team"]) & (x["at"] >= one["at"]) & (x["at"] <= one["at"] + soon))
        first = F.array_min(F.transform(answers, lambda x: F.struct(x["t"].alias("t"), x["kill_id"].alias("k"), x["killer"].alias("trader"))))
        return F.struct(one["kill_id"].alias("kill_id"), one["victim"].alias("traded"), first["trader"].alias("trader"))

    found = F.transform(F.filter("_all", lambda x: x["killer_team"] != x["victim_team"]), answered)
    return held.select("match_id", "round_id", F.explode(F.filter(found, lambda x: x["trader"].isNotNull())).alias("_one")).select("match_id", "round_id", "_one.*")


def end_of_feed(spark: SparkSession, after: DataFrame, days: int = 2) -> DataFrame:
    """One FEED row of no match (-1), ``days`` after all of ``after``: it moves the watermark past everything, for feeds that end.

    It is an elimination, so that filters which Spark puts before the watermark let it through.
    """
    last = after.agg(F.max("at").alias("at")).first()[0]
    row = spark.createDataFrame([(-1, 0, 0, -1, 0.0, -1, -2, TEAM_1, TEAM_2, 0, 0)], "match_id long, round_id long, round_number long, kill_id long, t double, killer long, victim long, killer_team string, victim_team string, size_1 long, size_2 long")
    row = row.withColumn("at", F.lit(last).cast("timestamp") + F.make_dt_interval(F.lit(days)))
    return after.limit(0).unionByName(row, allowMissingColumns=True)


def streamed(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, days: int = 1100) -> DataFrame:
    """What ``build`` appends for a FEED stream of ``rows``, which land as files in ``folder`` and end there; checkpoint and output lie beside them."""
    rows.write.parquet(f"{folder}/feed")
    end_of_feed(spark, spark.read.schema(FEED).parquet(f"{folder}/feed"), days).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    stream = build(spark.readStream.schema(FEED).parquet(f"{folder}/feed"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
