"""The canonical replay: what its plan reads, and random rounds against a plain replay row by row."""

import random

import pytest

from roundlens.operators import replay
from roundlens.sources.arena import Arena

SMALL = "/root/testdata/sf0.001"
ROUND = "match_id long, round_id long, round_number long, outcome string, planted boolean, plant_time double, exploded boolean, defused boolean, defuse_time double"
FEED = "match_id long, round_id long, kill_id long, seq long, killer long, victim long, t double, revived long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_round_is_replayed_in_one_pass(spark, no_broadcast):
    """The feed is read once and folded round by round: no windows of a few rows each, no second reading for who is alive."""
    a = Arena(spark, SMALL)
    for part in replay.canonical_replay(a.kill_events, a.rounds, a.match_players):
        got = plan(part)
        assert got.count("kill_events_") == 1 and "Window" not in got and "Exchange" not in got


def replayed(rows, teams, cause, terminal):
    """(moves with the state before and after, late rows), or None if a player acts or falls who is gone."""
    gone, left, moves, decided, late = set(), {"team-1": 5, "team-2": 5}, [], None, 0
    for seq, killer, victim, t, revived in rows:
        if revived is not None:
            killer = victim = None
        happens = victim is not None or revived in teams
        if decided is not None or not (happens and (terminal is None or t < terminal)):
            late += decided is not None or (terminal is not None and t >= terminal)
            continue
        before = tuple(left.values())
        if victim in gone or (killer in gone and killer != victim):
            return None
        if victim is not None:
            gone.add(victim)
            left[teams[victim]] -= 1
            if cause == "Elimination" and 0 in left.values():
                decided = seq
        elif revived in gone:
            gone.remove(revived)
            left[teams[revived]] += 1
        moves.append((seq, *before, *left.values()))
    return moves, late


def test_random_rounds_equal_a_plain_replay(spark):
    rng = random.Random(4)
    teams = {i: f"team-{1 + (i > 5)}" for i in range(1, 11)}
    seats = spark.createDataFrame([(1, i, i - 1, t, 100 + i) for i, t in teams.items()], "match_id long, match_player_id long, slot long, team string, player_id long")
    rounds, feed, want = [], [], {}
    for n in range(1, 301):
        cause, terminal = rng.choice([("Elimination", None), ("Elimination", None), ("Time", None), ("Defuse", 6.0), ("Detonate", 49.0)])
        rounds.append((1, n, 3, f"Team A {cause} Win", True, 4.0, False, False, 6.0))
        killers, victims, rows = rng.sample(range(1, 11), 10), rng.sample(range(1, 11), 10), []
        for seq in range(1, rng.randint(0, 12) + 1):
            revived = rng.choice([*victims[:seq], 77]) if rng.random() < 0.3 else None
            rows.append((seq, rng.choice([None, *killers[:3]]), rng.choice([None, victims[seq % 10], victims[seq % 10], victims[seq % 10]]), float(seq if seq < 9 else 5 * seq), revived))
        feed += [(1, n, 100 * n + seq, seq, k, v, t, r) for seq, k, v, t, r in rows]
        want[n] = replayed(rows, teams, cause, terminal)
    diagnostics, moves = replay.canonical_replay(spark.createDataFrame(feed, FEED), spark.createDataFrame(rounds, ROUND), seats)
    got = {r.round_id: r for r in diagnostics.collect()}
    states = {}
    for r in moves.collect():
        states.setdefault(r.round_id, []).append((r.seq, r.alive_1, r.alive_2, r.left_1, r.left_2))
    assert {n for n, w in want.items() if w is None} == {n for n, r in got.items() if r.reason == "ambiguous_lifecycle"}
    accepted = {n: w for n, w in want.items() if w is not None}
    assert {n: sorted(states.get(n, [])) for n in accepted} == {n: w[0] for n, w in accepted.items()} and len(accepted) > 60
    assert all((got[n].reason, got[n].entries, got[n].post_decision) == (None, len(w[0]) + 1, w[1]) for n, w in accepted.items()) and any(w[1] for w in accepted.values())


def test_a_query_derives_only_the_blocks_that_it_reads(spark, tmp_path):
    """Win rates need no duels, reconstructions no wins; both read the one replay that was written, once each."""
    import shutil

    from roundlens.operators import replay as R
    from roundlens.plans import fights
    from roundlens.plans.registry import QUERIES
    from roundlens.sources import tables

    for name, mine in (("j18_monotonicity", "fight_wins"), ("j18_reconstruction", "fight_duels")):
        folder = str(tmp_path / name)
        shutil.copytree(SMALL, folder)
        assert QUERIES[name](spark, folder).count() > 0
        assert {name for _, f, _, name in tables._kept if f == folder} == {"rounds", "match_players", "kill_events", "replayed", mine}
    a = Arena(spark, folder)
    for part in R.player_fight_blocks(a.kill_events, a.rounds, a.match_players, fights.tracked_roster(a), fights.replayed(a)):
        got = plan(part)
        assert got.count("default.replayed_") == 1 and "kill_events_" not in got


def test_draws_of_a_large_player_are_added_up_by_blocks(spark):
    """Matches in blocks: the same values and matches, intervals of draws as large, and every draw as many picks as matches."""
    import numpy as np

    from roundlens.operators import statistics

    rng = random.Random(6)
    wins = [(p, m, "attack", own, opp, 4, rng.randint(0, 2) + 2 * (own > opp)) for p, n in ((5, 90), (6, 10)) for m in range(n) for own, opp in ((3, 2), (2, 3))]
    duels = [(p, m, "attack", 3, 3, *[rng.randint(0, 2) for _ in range(6)]) for p, n in ((5, 90), (6, 10)) for m in range(n)]
    names = ", ".join(f"{p}_{c} long" for p in ("player", "tracked", "all") for c in ("kills", "deaths"))
    w, d = spark.createDataFrame(wins, "player_id long, match_id long, side string, own long, opp long, entries long, wins long"), spark.createDataFrame(duels, f"player_id long, match_id long, side string, own long, opp long, {names}")
    seats = spark.createDataFrame([(5, m) for m in range(91)] + [(6, m) for m in range(10)], "player_id long, match_id long")  # one match without a round
    whole, parts = ({(r.player_id, r.pool, r.side, r.own, r.opp): r.asDict() for r in statistics.fight_ev(w, d, seats, 1500, block=b).collect()} for b in (1000, 20))
    assert len(whole) == len(parts) == 200
    for key, a in whole.items():
        b = parts[key]
        assert all(a[c] == b[c] for c in a if c not in ("low", "high", "defined") and (key[0] == 6 or c != "state")) and (key[0] == 5 or a == b)
        if a["low"] is not None:
            assert abs(a["low"] - b["low"]) < 0.03 and abs(a["high"] - b["high"]) < 0.03 and abs(a["defined"] - b["defined"]) < 0.05
    assert any(r["low"] is not None for r in whole.values()) and parts[5, "all", "attack", 3, 3]["low"] != whole[5, "all", "attack", 3, 3]["low"]
    sizes = np.array([30, 40, 21])
    assert (sum(statistics._block_draws(sizes, at, 50, 2, 5)[0] for at in range(3)) == 91).all()
