"""Tables in buckets by match, their keeping, interval joins by bins, impact kept by match, repeats in sessions."""

import datetime
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from roundlens.operators import impact, intervals, replay, sessions, streaks, summaries, validation
from roundlens.sources import ingest, tables
from roundlens.sources.arena import Arena

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_match_joins_read_buckets_as_they_lie(spark, no_broadcast):
    a = Arena(spark, SMALL)
    scored = a.by_match("impact", lambda: impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats))
    assert "Exchange" not in plan(impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats))
    assert "Exchange" not in plan(summaries.match_summary(scored, a.rounds))
    assert "Exchange" not in plan(impact.trade_pairs(a.kill_events, a.match_players))
    assert "Exchange" not in plan(replay.fight_blocks(a.kill_events, a.rounds, a.match_players))


def test_a_match_table_follows_its_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for f in os.listdir(SMALL):
        shutil.copy(f"{SMALL}/{f}", folder / f)
    first = Arena(spark, str(folder)).rounds.count()
    assert first == Arena(spark, str(folder)).rounds.count() > 0
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").limit(10).cache()
    orders.count()
    shutil.rmtree(folder / "orders.parquet", ignore_errors=True) if (folder / "orders.parquet").is_dir() else os.remove(folder / "orders.parquet")
    orders.coalesce(1).write.parquet(str(folder / "orders.parquet"))
    assert Arena(spark, str(folder)).rounds.count() == 10


def test_a_store_outlives_the_application(spark, tmp_path):
    spark.conf.set(tables.STORE, f"file://{tmp_path}/store")
    try:
        built = []

        def build():
            built.append(1)
            return spark.createDataFrame([(m, m * 2.5, "x") for m in range(50)], "match_id long, v double, s string")

        want = sorted(map(tuple, tables.kept(spark, SMALL, "stored", build, "match_id").collect()))
        tables._kept.clear()  # as a new application has it
        again = tables.kept(spark, SMALL, "stored", build, "match_id")
        assert sorted(map(tuple, again.collect())) == want and len(built) == 1
        assert "Exchange" not in plan(again.groupBy("match_id").agg(F.sum("v")))
    finally:
        spark.conf.unset(tables.STORE)


def test_interval_join_equals_all_pairs(spark, no_broadcast):
    rng = random.Random(3)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    points = [(i, day(rng.randint(0, 2000)) if rng.random() < 0.9 else None) for i in range(200)]
    spans = [(k, day(s), None if rng.random() < 0.2 else day(s + rng.choice([0, 1, 24, 500, 3000]))) for k in range(40) for s in [rng.randint(-500, 2200)]] + [(99, None, None)]
    p, s = spark.createDataFrame(points, "id long, at timestamp_ntz"), spark.createDataFrame(spans, "span long, a timestamp_ntz, b timestamp_ntz")
    want = sorted((i, k) for i, at in points for k, a, b in spans if at is not None and a is not None and a <= at and (b is None or at < b))
    for days in (1, 7, 60):
        got = intervals.interval_join(p, s, "at", "a", "b", days)
        assert sorted(map(tuple, got.select("id", "span").collect())) == want
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert intervals.interval_join(p.where("false"), s, "at", "a", "b").count() == 0 == intervals.interval_join(p, s.where("false"), "at", "a", "b").count()
    arena = Arena(spark, SMALL)
    gaps = streaks.window_gaps(arena.matches, arena.match_players, sessions.map_windows(summaries.act_pools(arena.matches, arena.acts)), arena.acts)
    assert "NestedLoop" not in plan(gaps) and "NestedLoop" not in plan(summaries.in_acts(arena.matches, arena.acts))


def test_impact_is_kept_by_match(spark, tmp_path, monkeypatch):
    """Computed for some matches, then for others and again for changed ones, it is what computing all gives."""
    monkeypatch.setattr(ingest, "MATCHES_A_PART", 10)
    a, path = Arena(spark, SMALL), f"file://{tmp_path}/impact"
    whole = impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats)
    kept = lambda: spark.read.schema(whole.schema).parquet(path).select(whole.columns)
    ids = a.matches.select("match_id")
    first = ids.where("match_id % 3 > 0")
    impact.keep_impact(path, first, a.kill_events.where("victim % 5 > 0"), a.rounds, a.match_players, a.stats)  # a feed that lacks events
    impact.keep_impact(path, ids.where("match_id % 2 = 0"), a.kill_events, a.rounds, a.match_players, a.stats)
    assert kept().exceptAll(whole).count() > 0
    impact.keep_impact(path, ids.where("match_id % 2 = 1"), a.kill_events, a.rounds, a.match_players, a.stats)
    assert kept().exceptAll(whole).count() == 0 == whole.exceptAll(kept()).count()


def test_impact_follows_a_stream(spark, tmp_path):
    """Match ids land in files, one of them twice; each batch replaces its matches' rows."""
    from roundlens.streaming import live

    a, path = Arena(spark, SMALL), f"file://{tmp_path}/impact"
    ids = sorted(r.match_id for r in a.matches.where("match_id < 9").collect())
    for k, some in enumerate((ids[:4], ids[2:6], ids[6:])):
        spark.createDataFrame([(m,) for m in some], "match_id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    landed = spark.readStream.schema("match_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    tables_ = {"kill_events": a.kill_events, "rounds": a.rounds, "match_players": a.match_players, "stats": a.stats}
    query = live.score_as_they_land(landed, live.impact_sink(path, lambda: tables_), f"{tmp_path}/check")
    query.awaitTermination(300)
    assert query.exception() is None
    whole = impact.impact_scores(*tables_.values()).where(F.col("match_id") < 9)
    kept = spark.read.schema(whole.schema).parquet(path).select(whole.columns)
    assert kept.exceptAll(whole).count() == 0 == whole.exceptAll(kept).count() and kept.count() > 0


def test_repeats_split_by_shared_players(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    matches = spark.createDataFrame([(1, at(1), "A"), (2, at(2), "A"), (3, at(3), "B"), (4, at(4), "A")], "match_id long, played_at timestamp_ntz, map_name string")
    seats = [(m, p) for m, ps in ((1, range(10)), (2, range(10)), (3, [0, 1, 2, *range(20, 27)]), (4, [0, 1, 2, 3, *range(20, 26)])) for p in ps]
    seats = spark.createDataFrame(seats, "match_id long, player_id long")
    found = sessions.player_sessions(matches, seats)
    pairs = {}
    for p in {p for _, p in seats.collect()}:
        mine = [r for r in sorted(found.where(F.col("player_id") == p).collect(), key=lambda r: r.match_id)]
        for x, y in zip(mine, mine[1:]):
            if x.session == y.session:
                pairs[x.match_id, y.match_id] = True
    roster = {m: {p for n, p in seats.collect() if n == m} for m in (1, 2, 3, 4)}
    maps = {1: "A", 2: "A", 3: "B", 4: "A"}
    want = {}
    for x, y in pairs:
        k = len(roster[x] & roster[y])
        n, r = want.get(k, (0, 0))
        want[k] = (n + 1, r + (maps[x] == maps[y]))
    assert {r.shared: (r.pairs, r.repeats) for r in sessions.repeats_by_shared(found, matches, seats).collect()} == want and len(want) > 1
    gaps = {r.gap: r.n for r in sessions.session_gaps(found, matches).collect()}
    assert gaps == {1: 11, 2: 3}  # player 3 was not in the third match


def test_coverage_of_two_versions(spark):
    row = "match_id long, round_id long, match_player_id long"
    old, new = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 3, 1)], row), spark.createDataFrame([(1, 1, 2), (1, 2, 2), (3, 5, 1)], row)
    assert {tuple(r) for r in validation.coverage(old, new).collect()} == {(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)}


def test_parts_grow_with_the_input(spark, no_broadcast, tmp_path, monkeypatch):
    """Larger tables lie in more buckets, not in larger ones, and shuffles begin with as many parts."""
    from roundlens.sources import arena

    monkeypatch.setattr(arena, "ROUNDS_A_PART", 100)
    folder = tmp_path / "in"
    shutil.copytree(SMALL, folder)
    a = Arena(spark, str(folder))
    want = -(-spark.read.parquet(f"{SMALL}/orders.parquet").count() // 100)
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert a.parts >= want > int(spark.conf.get("spark.sql.shuffle.partitions")) and spark.conf.get(first) == str(a.parts)
        assert f"out of {a.parts}" in plan(a.rounds.join(a.stats, "match_id"))
        assert sorted(map(tuple, a.rounds.collect())) == sorted(map(tuple, Arena(spark, SMALL).rounds.collect()))
    finally:
        spark.conf.unset(first)


def test_impact_reads_its_steps_as_written(spark, no_broadcast):
    """A task of the last step sorts a few tables, not all that lead to them."""
    from roundlens.plans.scoring import scores

    a = Arena(spark, SMALL)
    whole = impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats)
    assert sorted(map(tuple, scores(a).collect())) == sorted(map(tuple, whole.collect()))
    written = [name for _, folder, _, name in tables._kept if folder == SMALL]
    assert {"swings", "kill_factors", "trades"} <= set(written)
    last = impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats, scores_step(a, "kill_factors"), scores_step(a, "trades"))
    assert plan(last).count("Sort [") <= 8 < plan(whole).count("Sort [")


def scores_step(a, name):
    return a.by_match(name, lambda: pytest.fail(f"{name} isn't written"))


def test_buckets_are_read_in_their_order(spark, no_broadcast, tmp_path):
    """Impact is dealt by match as it is computed, and joins by round and by seat sort neither side."""
    from roundlens.plans.scoring import scores

    shutil.copytree(SMALL, tmp_path / "in")
    a = Arena(spark, str(tmp_path / "in"))
    scored = scores(a)
    last = impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats, scores_step(a, "kill_factors"), scores_step(a, "trades"))
    assert "Exchange" not in plan(last.repartition(a.parts, "match_id"))
    for joined in (summaries.with_result(scored, a.rounds), scored.join(a.stats, ["match_id", "round_id", "match_player_id"])):
        assert "SortMergeJoin" in plan(joined) and "Sort [" not in plan(joined)
    by_round = scored.select("match_id", "round_id", "match_player_id")
    assert by_round.exceptAll(a.stats.select(by_round.columns)).count() == 0 == a.stats.select(by_round.columns).exceptAll(by_round).count()


def test_versions_are_compared_as_they_lie(spark, no_broadcast):
    """Only what is compared is written, in the order that it is joined in."""
    from roundlens.plans import fights

    old, new = fights._versions(Arena(spark, SMALL))
    assert set(old.columns) == set(new.columns) == {"match_id", "round_id", "match_player_id", "impact", "damage"}
    both = plan(validation.compared(old, new, ["impact", "damage"]))
    assert "SortMergeJoin" in both and "Sort [" not in both and "Exchange" not in both


def test_whole_numbers_are_those_of_six_decimals(spark):
    """Beside a half six decimals decide, and a half goes to the even number."""
    rng = random.Random(5)
    halves = [n + 0.5 + d for n in range(-20, 20) for d in (0, 1e-9, -1e-9, 4e-7, -4e-7, 6e-7, -6e-7, 9e-5, 2e-4)]
    rows = spark.createDataFrame([(x,) for x in [*halves, *(rng.uniform(-900, 900) for _ in range(500)), 0.0, -0.0, None]], "x double")
    said = rows.select(impact.whole(F.col("x")).alias("got"), F.bround(F.round("x", 6), 0).cast("long").alias("want"), "x").collect()
    assert all(r.got == r.want for r in said) and {0, 2, -2} <= {r.got for r in said}
    whole = plan(rows.select(impact.whole(F.col("x"))))
    assert "rint" in whole.lower()


def test_match_values_stay_with_their_match(spark, no_broadcast):
    """Counters meet by match, where they lie; only the narrow seats are dealt, to meet the names."""
    from roundlens.plans.social import match_values

    assert "hashpartitioning(match_player_id" not in plan(match_values(Arena(spark, SMALL)))


def test_steps_up_to_impact_hold_no_copies(spark):
    """Tables in buckets by match are merged, not broadcast, though these are small; the feed is dealt into all parts, which stay apart."""
    from roundlens.plans import fights
    from roundlens.plans.scoring import scores

    a = Arena(spark, SMALL)
    scores(a)
    swings, kills, found = scores_step(a, "swings"), scores_step(a, "kill_factors"), scores_step(a, "trades")
    steps = [a._stats(), impact.swing_risk(a.rounds, a.stats), impact.kill_factors(a.kill_events, a.rounds, a.match_players, a.stats, swings), impact.trades(impact.with_teams(a.kill_events, a.match_players))]
    steps += [impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats, kills, found), fights._compared(a), validation.coverage(*fights._versions(a))]
    assert not [step.columns for step in steps if "Broadcast" in plan(step)]
    feed = plan(a._kill_events())
    assert "REPARTITION_BY_NUM" in feed and "REPARTITION_BY_COL" not in feed


@pytest.mark.parametrize("name", ["d12_by_agent", "d12_by_map", "e6_maps_by_win_rate", "d14_leaderboard", "d7_match_summary", "d10_team_summary", "d11_profile", "d20_round_mvps"])
def test_queries_merge_buckets(spark, name):
    """Joins by match merge what lies alike, also where a copy would be small."""
    from roundlens.plans.registry import QUERIES

    got = plan(QUERIES[name](spark, SMALL))
    assert "SortMergeJoin" in got and "Broadcast" not in got


def test_matches_are_read_in_their_order(spark, no_broadcast):
    """Only the means, which are hashed, are sorted to meet the seats; matches lie sorted."""
    from roundlens.plans.registry import QUERIES

    assert plan(QUERIES["d12_by_map"](spark, SMALL)).count("Sort [") == 1


def test_win_rates_need_no_impact(spark, tmp_path):
    """Maps by win rate are told by matches and seats; nothing else is derived for them."""
    from roundlens.plans.registry import QUERIES

    shutil.copytree(SMALL, tmp_path / "in")
    got = QUERIES["e6_maps_by_win_rate"](spark, str(tmp_path / "in"))
    assert {name for _, folder, _, name in tables._kept if folder == str(tmp_path / "in")} == {"rounds", "matches", "match_players"}
    a = Arena(spark, SMALL)
    scored = a.by_match("impact", lambda: impact.impact_scores(a.kill_events, a.rounds, a.match_players, a.stats))
    columns = ["player_id", "map_name", "matches", "win_rate"]
    whole = summaries.grouped_profile(scored, a.match_players, a.matches, "map_name")
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
