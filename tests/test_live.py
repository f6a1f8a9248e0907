"""Live counters and trades: a feed in random micro-batches, stopped and started again, against the whole tables."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from roundlens.operators import impact, replay
from roundlens.sources.arena import Arena
from roundlens.streaming import counters

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The feed of some matches at one time, in files of random rows, repeated rows among them; the last file ends it."""
    a = Arena(spark, SMALL)
    few = a.matches.where("match_id < 60").withColumn("played_at", F.lit("2024-03-01 10:00:00").cast("timestamp_ntz"))
    feed = counters.feed_rows(a.kill_events, a.rounds, a.match_players, few)
    folder = str(tmp_path_factory.mktemp("feed"))
    rng = random.Random(5)
    rows = feed.collect()
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    for k in range(6):
        spark.createDataFrame(rows[k::6], counters.FEED).coalesce(1).write.parquet(f"{folder}/part{k}")
    counters.end_of_feed(spark, feed).coalesce(1).write.parquet(f"{folder}/part9")
    return a, folder, spark.createDataFrame(rows, counters.FEED)


def run(spark, folder, tmp, build, stops):
    """Feed the files in ``stops`` portions, each by a query of its own on one checkpoint."""
    source, out = tmp / "source", f"{tmp}/out"
    source.mkdir()
    files = [f for k in (0, 1, 2, 3, 4, 5, 9) for f in glob.glob(f"{folder}/part{k}/*.parquet")]
    size = -(-len(files) // stops)
    for at in range(0, len(files), size):
        for i, f in enumerate(files[at : at + size]):
            (source / f"{at + i:03d}.parquet").write_bytes(open(f, "rb").read())
        stream = spark.readStream.schema(counters.FEED).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    return spark.read.parquet(out)


def test_live_counters_equal_the_whole(spark, landed, tmp_path):
    a, folder, rows = landed
    got = run(spark, folder, tmp_path, lambda s: counters.live_counters(s, "3 hours", 3_600_000), 2)
    ids = rows.select("match_id").distinct()
    seats = a.match_players.join(ids, "match_id", "left_semi")
    feed, rounds = a.kill_events.join(ids, "match_id", "left_semi"), a.rounds.join(ids, "match_id", "left_semi")
    closed = got.where("closed and match_id >= 0")
    streaks = sorted((r.match_player_id, r.streak) for r in closed.where("kind = 'streak'").collect())
    assert streaks == sorted(map(tuple, replay.kill_streaks(feed, rounds, seats).collect())) and len(streaks) > 100
    key = ["match_id", "round_id", "team", "own", "opp", "seq"]
    assert sorted(map(tuple, closed.where("kind = 'clutch'").select(key).collect())) == sorted(map(tuple, replay.clutches(feed, rounds, seats).select(key).collect()))
    assert got.where("not closed").count() > len(streaks)  # told along the way


def test_live_trades_equal_the_whole(spark, landed, tmp_path):
    a, folder, rows = landed
    got = run(spark, folder, tmp_path, lambda s: counters.live_trades(s, "3 hours"), 2)
    ids = rows.select("match_id").distinct()
    want = impact.trades(impact.with_teams(a.kill_events.join(ids, "match_id", "left_semi"), a.match_players))
    key = ["match_id", "round_id", "kill_id", "traded", "trader"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect())) and want.count() > 20


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    def row(minute, kill, killer, victim, team, other):
        return (1, f"2024-03-01 10:{minute:02d}:00", 1, 1, kill, 1.0 * minute, killer, victim, team, other, None, 5, 5)

    source = tmp_path / "in"
    for k, rows in enumerate(([row(0, 1, 10, 20, "team-1", "team-2"), row(50, 2, 11, 21, "team-1", "team-2")], [row(0, 3, 22, 10, "team-2", "team-1"), row(50, 4, 23, 11, "team-2", "team-1")], [row(59, 5, 12, 23, "team-1", "team-2")])):
        df = spark.createDataFrame(rows, counters.FEED.replace("at timestamp", "at string")).withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(counters.FEED).parquet(str(source))
        counters.live_trades(stream, "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.kill_id, r.trader) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert got == [(2, 23)]  # the answer to the first came fifty minutes late


def test_trades_keep_each_row_once(spark, landed):
    """A session's rows are the state; no join holds the feed on both sides."""
    _, folder, _ = landed
    stream = spark.readStream.schema(counters.FEED).parquet(f"{folder}/part0")
    assert "Join" not in counters.live_trades(stream, "1 hour")._jdf.queryExecution().analyzed().toString()


def test_a_batch_reads_and_writes_a_match_once():
    import pandas as pd

    calls = []

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, new):
            calls.append("update")
            self.held = new

    class Handle:
        getValueState = getMapState = lambda self, *a: Value()
        registerTimer = deleteTimer = lambda self, at: None

    rows = pd.DataFrame([(1, pd.Timestamp("2024-03-01"), 1, 1, k, float(k), 10, 20 + k, "team-1", "team-2", None, 5, 5) for k in range(1, 5)], columns=[c.split()[0] for c in counters.FEED.split(", ")])
    one = counters.MatchCounters(1000)
    one.init(Handle())
    for _ in range(2):  # repeated rows do no harm
        told = pd.concat(one.handleInputRows((1,), iter([rows]), None))
    assert calls == ["update", "get", "update"] and told.where(told.kind == "streak").streak.max() == 4


def test_event_times_of_any_year(spark, landed, tmp_path):
    """Times beyond 2262, where nanoseconds end, count like others."""
    a, _, rows = landed
    ids = rows.select("match_id").distinct().where("match_id < 6")
    far = rows.join(ids, "match_id", "left_semi").withColumn("at", F.col("at") + F.expr("interval 700 years"))
    got = counters.streamed(spark, far, lambda s: counters.live_counters(s, "1000 days", 3_600_000), str(tmp_path))
    want = replay.kill_streaks(a.kill_events.join(ids, "match_id", "left_semi"), a.rounds.join(ids, "match_id", "left_semi"), a.match_players)
    closed = got.where("closed and kind = 'streak' and match_id >= 0")
    assert sorted((r.match_player_id, r.streak) for r in closed.collect()) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_matches_of_a_key_close_by_themselves():
    """Two matches in one value: read and written once a batch, each closed when it has been still; late rows count while their match is open."""
    import pandas as pd

    calls, timers = [], set()

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: calls.append("get") or self.held

        def update(self, new):
            calls.append("update")
            self.held = new

        def clear(self):
            self.held = None

    class Handle:
        getValueState = lambda self, *a: Value()
        registerTimer = lambda self, at: timers.add(at)
        deleteTimer = lambda self, at: timers.remove(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    names = ["match_id", "at", "round_id", "round_number", "kill_id", "t", "killer", "victim", "victim_team", "winner", "size_1", "size_2"]
    frame = lambda match, at, kill: pd.DataFrame([(match, at, match, 1, kill, float(kill), 10, 20 + kill, "team-2", None, 5, 5)], columns=names)
    one = counters.MatchCounters(1000)
    one.init(Handle())
    told = pd.concat(one.handleInputRows((0,), iter([frame(1, 5000, 1), frame(2, 9000, 2)]), At(0)))
    assert calls == ["update"] and timers == {6000} and set(told.match_id) == {1, 2} and not told.closed.any()
    late = pd.concat(one.handleInputRows((0,), iter([frame(1, 5000, 3), frame(3, 5500, 4)]), At(5900)))
    assert set(late.match_id) == {1} and late.streak.max() == 2  # the third match would have been open, had it come in time
    done = pd.concat(one.handleExpiredTimer((0,), At(6001), At(6000)))
    assert set(done.match_id) == {1} and done.closed.all() and done.streak.max() == 2 and 10000 in timers
    assert set(pd.concat(one.handleExpiredTimer((0,), At(20000), At(10000))).match_id) == {2} and not one.open.exists()
