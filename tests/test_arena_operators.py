"""Facts of the match operators on small hand-made rows, ingestion, and the registered SQL on the smallest tables."""

import glob
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from roundlens.functions import scoring as S
from roundlens.operators import economy, impact, replay, sessions, social, statistics, summaries
from roundlens.sources import ingest
from roundlens.streaming import live

DATA = "/root/testdata/sf0.001"
ROUND = "match_id long, round_id long, round_number long, outcome string, planted boolean, plant_time double, exploded boolean, defused boolean, defuse_time double"
FEED = "match_id long, round_id long, kill_id long, seq long, killer long, victim long, t double"


def seats(spark, match=1):
    return spark.createDataFrame([(match, i, i - 1, f"team-{1 + (i > 5)}", 0) for i in range(1, 11)], "match_id long, match_player_id long, slot long, team string, agent_no long")


def feed(spark, kills):
    return spark.createDataFrame([(1, 1, i + 1, i + 1, k, v, float(t)) for i, (k, v, t) in enumerate(kills)], FEED)


def one_round(spark, outcome="Team A Elimination Win", number=3, plant=None, defuse=None):
    return spark.createDataFrame([(1, 1, number, outcome, plant is not None, plant, False, defuse is not None, defuse)], ROUND)


def diagnostics(spark, kills, **kw):
    return replay.canonical_replay(feed(spark, kills), one_round(spark, **kw), seats(spark))[0].first()


WIPE = [(1, 6, 1), (1, 7, 2), (2, 8, 3), (3, 9, 4), (4, 10, 5)]


def test_canonical_replay_facts(spark):
    assert diagnostics(spark, [])["entries"] == 1
    wiped = diagnostics(spark, WIPE)
    assert (wiped["entries"], wiped["duels"], wiped["post_decision"]) == (6, 5, 0)
    after = diagnostics(spark, [*WIPE, (1, 2, 6)])
    assert (after["duels"], after["post_decision"]) == (5, 1)
    assert diagnostics(spark, [(1, 6, 1), (2, 7, 20)], outcome="Team B Defuse Win", plant=2.0, defuse=20.0)["entries"] == 2
    assert diagnostics(spark, [(1, 6, 1), (2, 7, 1)])["reason"] == "equal_time_ambiguity"
    assert diagnostics(spark, [(1, 6, 1), (2, 6, 2)])["reason"] == "ambiguous_lifecycle"
    assert diagnostics(spark, [], number=25)["reason"] == "overtime_unknown_side"
    assert diagnostics(spark, [], outcome="Team A Surrendered Win")["reason"] == "surrendered"
    assert diagnostics(spark, [], outcome=None)["reason"] == "unknown_winner"
    assert diagnostics(spark, [], outcome="Team A Odd Win")["reason"] == "unrecognized_round_result"
    assert diagnostics(spark, [], outcome="Team A Defuse Win")["reason"] == "missing_terminal_time"
    own = diagnostics(spark, [(1, 1, 1)])
    assert (own["entries"], own["duels"]) == (2, 0)


def test_revived_victims_are_not_counted_out(spark):
    rows = impact.alive_counts(impact.with_teams(feed(spark, [(1, 6, 1), (6, 2, 2), (3, 6, 3), (None, 4, 4), (5, 7, 5)]), seats(spark))).orderBy("seq").collect()
    assert [(r.alive_1, r.alive_2) for r in rows] == [(5, 5), (5, 5), (4, 5), (4, 4), (3, 4)]


def test_trades(spark):
    found = impact.trades(impact.with_teams(feed(spark, [(6, 1, 1), (2, 6, 5), (7, 2, 30), (3, 7, 41)]), seats(spark))).collect()
    assert [(r.traded, r.trader) for r in found] == [(1, 2)]


@pytest.mark.parametrize(("losing", "other", "weight"), [(5, 5, 150), (1, 1, 250), (4, 2, 130), (2, 4, 80), (0, 3, 100), (6, 1, 100)])
def test_order_weights(spark, losing, other, weight):
    assert spark.range(1).select(S.order_weight(F.lit(losing), F.lit(other))).first()[0] == weight


def test_time_factor(spark):
    args = lambda t, **k: [F.lit(v) for v in (t, True, 20.0, k.get("exploded", False), k.get("defused", False), k.get("at"))]
    value = lambda *a, **k: spark.range(1).select(S.time_factor(*a, **k)).first()[0]
    assert value(*args(10.0)) == 1 and value(*args(20.0)) == 1 and value(*args(60.0)) == 1.75 and value(*args(60.0), for_death=True) == 0.5
    assert value(*args(66.0, exploded=True)) == 0.5 and abs(value(*args(46.5)) - 1.5) < 1e-9


def stat(spark, rows):
    return spark.createDataFrame([(1, n, n, 1, "team-1", k, d, load, left) for n, k, d, load, left in rows], "match_id long, round_id long, round_number long, match_player_id long, team string, kills long, deaths long, loadout long, remaining long")


@pytest.mark.parametrize(("old", "new", "sugar", "scavenger"), [((2, 0, 0, 0, 5000), (3, 0, 0, 0, 4000), 1250, 0), ((2, 0, 1, 0, 5000), (3, 0, 0, 0, 4000), 0, 0), ((2, 0, 1, 0, 0), (3, 0, 0, 4000, 900), 0, 3000)])
def test_credits(spark, old, new, sugar, scavenger):
    rounds = spark.createDataFrame([(1, n, n, "Team B Elimination Win", False, None, False, False, None) for n in (2, 3)], ROUND)
    won_first = spark.createDataFrame([(1, 1, 1, "Team A Elimination Win", False, None, False, False, None)], ROUND)
    got = economy.credits(stat(spark, [old, new]), rounds.unionAll(won_first), seats(spark)).collect()
    assert [(r.round_number, r.sugar, r.scavenger) for r in got] == [(3, sugar, scavenger)]


def test_sessions(spark):
    times = ["2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 20:30:00", None]
    matches = spark.createDataFrame([(i, t, 13, 5) for i, t in enumerate(times)], "match_id long, t string, team1_rounds_won long, team2_rounds_won long").withColumn("played_at", F.col("t").cast("timestamp_ntz"))
    people = spark.createDataFrame([(m, p, "team-1") for m in range(4) for p in (1, 2, 3, 10 + m)], "match_id long, player_id long, team string")
    found = sessions.player_sessions(matches, people)
    assert sorted((r.match_id, r.session) for r in found.where("player_id = 1").collect()) == [(0, 0), (1, 0), (2, 1)]
    first = sessions.session_summary(found, matches, people).where("player_id = 1 and session = 0").first()
    assert (first["matches"], first["wins"], first["losses"], first["roster"], first["core"]) == (2, 2, 0, 5, 3)


def test_statistics(spark):
    rows = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, 20.0), (1, 3.0, 15.0)], "g long, a double, b double")
    assert statistics.spearman(rows, "g", "a", "b").first()["rho"] == 0.5
    hazard = spark.createDataFrame([(1, 0, 10), (2, 5, 10)], "gap long, chosen long, offered long")
    got = statistics.log_likelihood(hazard).first()
    assert abs(got["ll_null"] - (5 * math.log(0.25) + 15 * math.log(0.75))) < 1e-5 and got["ll_gap"] > got["ll_null"]


def test_shoutouts_reach_most_players(spark):
    rows = [(1, "entry", 0, 1, 0), (1, "entry", 0, 2, 1), (1, "late", 1, 1, 0), (1, "eco", 2, 1, 0), (1, "eco", 2, 3, 1)]
    got = {r.player_id: r.category for r in social.assign_shoutouts(spark.createDataFrame(rows, "scope_id long, category string, priority long, player_id long, rank long")).collect()}
    assert got == {1: "late", 2: "entry", 3: "eco"}


def test_friends(spark):
    edges = spark.createDataFrame([(1, 2)], "owner_id long, friend_id long")
    more = social.add_friends(edges, spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "owner_id long, friend_id long"))
    assert {tuple(r) for r in more.collect()} == {(1, 2), (2, 1)}
    assert {tuple(r) for r in social.remove_friends(more, edges).collect()} == {(2, 1)}


DOCUMENT = {
    "attributes": {"id": "m1"},
    "metadata": {"mapName": "Map1", "dateStarted": "2024-01-02T03:04:05Z", "modeName": "Competitive"},
    "segments": [
        {"type": "player-summary", "attributes": {"platformUserIdentifier": "A#1", "teamId": "Red"}, "metadata": {"agentName": "X"}},
        {"type": "round-summary", "attributes": {"round": 1}, "roundResult": "Elimination", "winningTeam": "Red", "stats": {}},
        {"type": "round-summary", "attributes": {"round": 2}, "roundResult": "Surrendered", "winningTeam": "Red"},
        {"type": "player-round", "attributes": {"platformUserIdentifier": "A#1", "round": 1}, "stats": {"kills": 2, "score": 300}},
        {"type": "player-round", "attributes": {"platformUserIdentifier": "nobody", "round": 1}, "stats": {}},
        {"type": "player-round-kills", "attributes": {"platformUserIdentifier": "A#1", "round": 1}, "gameTime": 4500},
    ],
}


def test_ingestion(spark, tmp_path):
    (tmp_path / "m1.json").write_text(json.dumps(DOCUMENT))
    (tmp_path / "again.json").write_text(json.dumps(DOCUMENT))
    got = ingest.normalise(ingest.read_match_documents(spark, str(tmp_path)))
    assert got["matches"].count() == got["match_players"].count() == 1
    assert [r.outcome for r in got["rounds"].collect()] == ["Team A Elimination Win"]
    assert [(r.kills, r.score, r.deaths) for r in got["round_player_stats"].collect()] == [(2, 300, 0)]
    kill = got["kill_events"].first()
    assert (kill.weapon, kill.t, kill.victim) == ("Unknown", 4.5, None)
    assert ingest.discover(got["matches"], got["matches"]).count() == 0
    keys = ingest.with_new_keys(spark.createDataFrame([(7, "a")], "player_id long, display_name string"), spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "display_name string"), "player_id", "display_name")
    assert sorted(r.player_id for r in keys.collect()) == [7, 8, 9]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "external_id string, n long")
    assert {tuple(r) for r in ingest.replace_matches(df, df.where("n = 1").withColumn("n", F.lit(9).cast("long"))).collect()} == {("m1", 9), ("m2", 2)}
    assert ingest.insert_matches(df, df).count() == 2
    for kind in ("json", "csv", "parquet"):
        ingest.write_snapshot(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 2


def test_strings(spark):
    df = spark.createDataFrame([("Split10241130",), ("Bind1111111",), ("x",)], "file string")
    got = {r.file: (r.map_name, str(r.played_at)) for r in ingest.parse_file_names(df).collect()}
    assert got["Split10241130"] == ("Split", "2024-10-24 23:30:00") and got["Bind1111111"][1] == "None"
    row = spark.range(1).select(ingest.minutes_seconds(F.lit("2:05")), ingest.first_outcome(F.lit("x Team B Time Win y")), ingest.thousands(F.lit("1,250")), ingest.bar_loadout(F.lit(4.0))).first()
    assert tuple(row) == (125, "Team B Time Win", 1250, 2500)
    icons = spark.createDataFrame([(1, 0b1011), (2, -1)], "icon_id long, hash long")
    known = spark.createDataFrame([(0b1001, "Jett"), (0b111111111111, "Sage")], "hash long, label string")
    assert {r.icon_id: r.label for r in ingest.classify_icons(icons, known).collect()} == {1: "Jett", 2: "BAD CLASSIFICATION!"}


def test_stream_of_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(DOCUMENT))
    seen = []
    live.score_as_they_land(live.landed_documents(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.external_id for r in df.collect()), str(tmp_path / "check")).awaitTermination(120)
    assert seen == ["m1"]


@pytest.mark.parametrize("name", ["d2_kda", "d27_impact", "g5_canonical", "h1_sessions", "j10_hazard", "d24_tier_matrix", "f16_credits"])
def test_registered_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    show = lambda rows: sorted(str(tuple(f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r)) for r in rows)
    want = show(cursor.fetchall())
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert show(got.select(*columns).collect()) == want


def test_summaries_of_nothing(spark):
    none = stat(spark, []).withColumn("assists", F.lit(0)).withColumn("score", F.lit(0))
    assert summaries.kda(none).count() == summaries.round_econ(none).count() == 0


def test_maps_of_any_lobby(spark):
    import datetime

    day = lambda n: datetime.datetime(2024, 3, n)
    names = ["A", "B", "A", "B", "A", "B", "A"]
    matches = spark.createDataFrame([(i, m, day(i + 1)) for i, m in enumerate(names)], "match_id long, map_name string, played_at timestamp_ntz")
    seats = spark.createDataFrame([(i, 100 + i) for i in range(7)], "match_id long, player_id long")
    acts = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "act_id long, act_start timestamp_ntz")
    lobbies = spark.createDataFrame([(1, 100), (1, 102), (1, 101), (2, 103), (2, 999)], "lobby_id long, player_id long")
    got = {(r.lobby_id, r.map_name): r.p for r in sessions.predict_maps(matches, seats, acts, lobbies).collect()}
    a, b = 4 / 7, 3 / 7
    for lobby, unknown, fa, fb in ((1, 7, 0.2, 0.47), (2, 8, 1.0, 0.47)):
        wa, wb = a * fa * (1 - a * 0.53) ** unknown, b * fb * (1 - b * 0.53) ** unknown
        assert got[lobby, "A"] == pytest.approx(wa / (wa + wb), abs=1e-5) and got[lobby, "B"] == pytest.approx(wb / (wa + wb), abs=1e-5)


@pytest.mark.parametrize("name", ["j7_predict_maps", "j7_predict_lobbies"])
def test_registered_sql_of_map_predictions(spark, name):
    test_registered_sql(spark, name)


def test_fight_ev_per_player_side_and_pool(spark):
    game = spark.createDataFrame([(1, i, i - 1, f"team-{1 + (i > 5)}", 100 + i) for i in range(1, 11)], "match_id long, match_player_id long, slot long, team string, player_id long")
    roster = spark.createDataFrame([(101,), (102,)], "player_id long")
    wins, duels = replay.player_fight_blocks(feed(spark, WIPE), one_round(spark), game, roster)
    first = {(r.own, r.opp): (r.entries, r.wins) for r in wins.where("player_id = 103 and side = 'attack'").collect()}
    assert first == {(5, k): (1, 1) for k in range(6)}
    got = {r.opp: (r.player_kills, r.tracked_kills, r.all_kills) for r in duels.where("player_id = 103").collect()}
    assert got == {5: (0, 1, 1), 4: (0, 1, 1), 3: (0, 1, 1), 2: (1, 0, 0), 1: (0, 0, 1)}

    seats = spark.createDataFrame([(1, m) for m in range(8)], "player_id long, match_id long")
    wins = spark.createDataFrame([(1, m, "attack", 4, 5, 4, m % 3) for m in range(8)] + [(1, m, "attack", 5, 4, 4, 3 + m % 2) for m in range(8)], "player_id long, match_id long, side string, own long, opp long, entries long, wins long")
    names = ", ".join(f"{p}_{c} long" for p in ("player", "tracked", "all") for c in ("kills", "deaths"))
    duels = spark.createDataFrame([(1, m, "attack", 5, 5, 4, 1 + m % 2, *((1, 2) if m < 3 else (0, 0)), 1, 3) for m in range(8)], f"player_id long, match_id long, side string, own long, opp long, {names}")
    cells = {(r.pool, r.side, r.own, r.opp): r for r in statistics.fight_ev(wins, duels, seats).collect()}
    assert len(cells) == 100
    cell = cells["all", "attack", 5, 5]
    w_u, w_d, p = (28) / 32, sum(m % 3 for m in range(8)) / 32, 32 / 44
    assert cell.m == pytest.approx((p - 0.25) * (w_u - w_d)) and cell.low < cell.m < cell.high and cell.state == "POSITIVE" and cell.defined == 1
    assert (cell.matches_player, cell.matches_teammates, cell.matches_w_u, cell.matches_w_d) == (8, 8, 8, 8)
    assert cells["tracked", "attack", 5, 5].state == "INTERVAL_NOT_ESTIMABLE" and cells["tracked", "attack", 5, 5].matches_teammates == 3
    assert cells["all", "defend", 5, 5].state == "NO_DATA"
