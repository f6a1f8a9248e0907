"""Facts of revives, fight values, standing counters, sessions' sides and the assignment of shoutouts, on hand-made rows."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from roundlens.operators import diagrams, models, replay, rosters, social, standing, streaks, validation

ROUND = "match_id long, round_id long, round_number long, outcome string, planted boolean, plant_time double, exploded boolean, defused boolean, defuse_time double"
FEED = "match_id long, round_id long, kill_id long, seq long, killer long, victim long, t double, revived long"


def seats(spark):
    return spark.createDataFrame([(1, i, i - 1, f"team-{1 + (i > 5)}", 100 + i) for i in range(1, 11)], "match_id long, match_player_id long, slot long, team string, player_id long")


def feed(spark, kills):
    return spark.createDataFrame([(1, 1, i + 1, i + 1, k, v, float(t), r) for i, (k, v, t, r) in enumerate(kills)], FEED)


def one_round(spark, outcome="Team A Elimination Win", number=3):
    return spark.createDataFrame([(1, 1, number, outcome, False, None, False, False, None)], ROUND)


def test_revived_players_stand_again(spark):
    """A player falls, returns and falls again: the same state is entered twice, and the round is accepted."""
    rows = [(6, 1, 1, None), (None, None, 2, 1), (7, 1, 3, None)]
    diagnostics, moves = replay.canonical_replay(feed(spark, rows), one_round(spark), seats(spark))
    found = diagnostics.first()
    assert (found.reason, found.entries, found.duels) == (None, 4, 2)
    assert [(r.left_1, r.left_2) for r in moves.orderBy("seq").collect()] == [(4, 5), (5, 5), (4, 5)]
    # Without the return, the second fall can't be.
    assert replay.canonical_replay(feed(spark, [rows[0], rows[2]]), one_round(spark), seats(spark))[0].first().reason == "ambiguous_lifecycle"
    # One who fell can't strike, until back; a return of one who stands changes nothing; strangers change nothing.
    assert replay.canonical_replay(feed(spark, [(6, 1, 1, None), (1, 7, 2, None)]), one_round(spark), seats(spark))[0].first().reason == "ambiguous_lifecycle"
    again = replay.canonical_replay(feed(spark, [(6, 1, 1, None), (None, None, 2, 1), (1, 7, 3, None), (None, None, 4, 2), (None, None, 5, 77)]), one_round(spark), seats(spark))
    assert again[0].first().reason is None and [(r.left_1, r.left_2) for r in again[1].orderBy("seq").collect()] == [(4, 5), (5, 5), (5, 4), (5, 4)]


def fights(spark, wins, duels):
    names = ", ".join(f"{p}_{c} long" for p in ("player", "tracked", "all") for c in ("kills", "deaths"))
    return spark.createDataFrame(wins, "player_id long, match_id long, side string, own long, opp long, entries long, wins long"), spark.createDataFrame(duels, f"player_id long, match_id long, side string, own long, opp long, {names}")


def test_fight_points(spark):
    wins, duels = fights(spark, [(1, 1, "attack", 3, 2, 10, 8), (1, 1, "attack", 2, 3, 10, 2)], [(1, 1, "attack", 3, 3, 6, 4, 3, 7, 3, 7)])
    cells = {(r.pool, r.side, r.own, r.opp): r for r in replay.fight_points(wins, duels).collect()}
    assert len(cells) == 100
    cell = cells["all", "attack", 3, 3]
    assert (cell.leverage, cell.m, cell.state) == (0.6, 0.18, "POSITIVE")
    assert cells["all", "attack", 4, 1].w_u == 1.0 and cells["all", "defend", 1, 4].w_d == 0.0 and cells["all", "defend", 4, 4].state == "NO_DATA"
    wins, duels = fights(spark, [(1, 1, "attack", 3, 2, 10, 2), (1, 1, "attack", 2, 3, 10, 8)], [(1, 1, "attack", 3, 3, 6, 4, 3, 7, 3, 7)])
    swapped = {(r.pool, r.side, r.own, r.opp): r for r in replay.fight_points(wins, duels).collect()}["all", "attack", 3, 3]
    assert (swapped.state, swapped.m, swapped.leverage) == ("NON_POSITIVE_LEVERAGE", None, -0.6)


def test_validation_checks(spark):
    wins, duels = fights(spark, [(1, 1, "attack", 2, 2, 10, 6), (1, 1, "attack", 3, 2, 10, 5), (1, 1, "attack", 2, 3, 10, 7), (1, 1, "defend", 2, 2, 10, 8), (1, 1, "attack", 0, 3, 4, 1)], [(1, 1, "attack", 2, 2, 1, 1, 0, 0, 2, 2)])
    rates = validation.win_rates(wins)
    assert {(r.own, r.opp, r.kind) for r in validation.monotonicity(rates).where("side = 'attack'").collect()} >= {(2, 2, "own"), (2, 2, "opp")}
    flags = validation.complements(rates).collect()
    assert [(r.own, r.opp, r["diff"]) for r in flags] == [(2, 2, 0.4)]
    assert {(r.own, r.opp): (r.w, r.entries) for r in validation.boundaries(rates).where("side = 'attack'").collect()}[0, 3] == (0.25, 4)
    from roundlens.operators import statistics

    seats_ = spark.createDataFrame([(1, 1), (1, 2), (1, 1)], "player_id long, match_id long")
    cells = statistics.fight_ev(wins, duels, seats_, 50)
    diagnostics = spark.createDataFrame([(1, None), (1, "ties"), (2, None), (2, "ties"), (3, "x")], "match_id long, reason string")
    got = validation.report(wins, duels, cells, diagnostics, seats_).select(F.from_json("report", validation.REPORT).alias("r")).first().r
    assert (got.player_id, got.matches_considered, got.accepted_rounds) == (1, 2, 2) and [tuple(x) for x in got.excluded_rounds] == [("ties", 2)]
    assert len(got.cells) == 100 and [tuple(x) for x in got.reconstruction] == [("attack", 2, 2, 3, 3)] and got.thresholds.least_matches == statistics.LEAST_MATCHES
    assert [tuple(x) for x in got.complements] == [(2, 2, 0.6, 0.8, 0.4)] and len(got.boundaries) == 10


def test_standing_counters(spark):
    rows = [(1, 6, 1, None), (7, 1, 2, None), (7, 2, 3, None), (7, 3, 4, None), (4, 7, 5, None), (8, 4, 6, None), (8, 5, 7, None)]
    stats = spark.createDataFrame([(1, 1, 3, i, f"team-{1 + (i > 5)}", {1: 1, 7: 3, 4: 1, 8: 2}.get(i, 0)) for i in range(1, 11)], "match_id long, round_id long, round_number long, match_player_id long, team string, kills long")
    got = {r.match_player_id: r for r in standing.standing_counters(feed(spark, rows), one_round(spark, "Team B Elimination Win"), seats(spark), stats).collect()}
    assert (got[1].even_fight_kills, got[7].outnumbered_kills, got[7].even_fight_kills, got[4].outnumbered_kills) == (1, 1, 1, 1)
    assert got[4].kills_of_top == 1 and got[7].kills_of_top == 1 and got[5].last_in_wipe == 1 and sum(r.last_in_wipe for r in got.values()) == 1
    assert {(r.team, r.top, r.bottom) for r in standing.fraggers(stats).collect()} == {("team-1", 1, 2), ("team-2", 7, 6)}
    down = [(1, 6, 1, None), (7, 1, 2, None), (7, 2, 3, None), (7, 3, 4, None), (7, 4, 5, None)]
    assert {r.match_player_id for r in standing.clutch_resolvers(feed(spark, down), one_round(spark), seats(spark)).collect()} == {5}


def times(spark, rows):
    return spark.createDataFrame([(i, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), a, b) for i, n, h, a, b in rows], "match_id long, map_name string, played_at timestamp_ntz, team1_rounds_won long, team2_rounds_won long")


def test_sides_of_sessions(spark):
    matches = times(spark, [(1, "A", 0, 13, 5), (2, "A", 2, 13, 13), (3, "A", 20, 13, 5), (4, "A", 40, 13, 5), (5, "A", 41, 5, 13)])
    us, them = [1, 2, 3], {1: [11, 12, 13], 2: [21, 22, 23], 3: [31], 4: [1, 41], 5: [2, 3]}
    people = [(m, p, "team-1") for m in (1, 2, 3) for p in us] + [(m, p, "team-2") for m in (1, 2, 3) for p in them[m]]
    people += [(4, 1, "team-1"), (4, 2, "team-1"), (4, 3, "team-2"), (4, 4, "team-2"), (5, 1, "team-1"), (5, 2, "team-1"), (5, 3, "team-2"), (5, 4, "team-2")]
    seats = spark.createDataFrame(people, "match_id long, player_id long, team string")
    players = spark.createDataFrame([(p, f"P{p:02d}") for p in {p for _, p, _ in people}], "player_id long, display_name string")
    scope = spark.createDataFrame([(9, 1)], "scope_id long, player_id long")
    found = rosters.scoped_sessions(matches, seats, scope)
    assert {r.match_id: r.session for r in found.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2}
    got = {r.session: r for r in rosters.session_rosters(rosters.session_sides(found, seats), matches, seats, players).collect()}
    assert (got[0].wins, got[0].losses, got[0].roster, got[0].core, got[0].names, got[0].ambiguous) == (1, 1, 3, 3, "P01, P02, P03", 0)
    assert (got[1].wins, got[1].losses, got[1].roster, got[1].core, got[1].ambiguous) == (0, 0, 4, 4, 0)
    assert (got[2].wins, got[2].losses, got[2].ambiguous, got[2].roster) == (0, 0, 2, 4)


def test_streaks_of_maps(spark):
    """Pool threshold, merged acts, a record that isn't the current run."""
    acts = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 11)), (2, datetime.datetime(2024, 1, 11), None)], "act_id long, act_start timestamp_ntz, act_end timestamp_ntz")
    names = ["A", "B", "B", "B", "A", "B"]
    matches = times(spark, [(i, n, 60 * i, 13, 5) for i, n in enumerate(names)])
    seats = spark.createDataFrame([(i, 7) for i in range(6)], "match_id long, player_id long")
    pools = spark.createDataFrame([(1, "A"), (2, "A"), (2, "C")], "act_id long, map_name string")
    got = {r.map_name: r for r in streaks.map_streaks(matches, seats, pools, acts).collect()}
    assert (got["A"].current_gap, got["A"].record_gap, got["A"].record_from, got["A"].record_to, got["A"].record_ongoing, got["A"].record_is_current) == (1, 3, 1, 2, False, False)
    assert (got["C"].current_gap, got["C"].record_gap, got["C"].record_ongoing, got["C"].record_is_current) == (2, 2, True, True)
    assert streaks.map_streaks(matches.limit(0), seats, pools, acts).count() == 0


def test_lobbies_and_models(spark):
    matches = times(spark, [(i, "AB"[i % 2], i, 13, 5) for i in range(6)])
    seats = spark.createDataFrame([(i, p) for i in range(6) for p in (1, 2)], "match_id long, player_id long")
    got = models.lobby_test(matches, seats).first()
    assert (got.total, got.hits, got.expected, got.variance) == (5, 0, 2.5, 1.25) and got.z == pytest.approx(-2.5 / 1.25**0.5, abs=1e-4)
    hazard = spark.createDataFrame([(g, 1 if g == 1 else 15, 100) for g in range(1, 21)], "gap long, chosen long, offered long")
    rows = {r.model: r for r in models.compare_models(hazard).collect()}
    assert rows["null"].gain == 0 and rows["gap_1"].gain > 10 and (rows["tail"].a, rows["recovery"].a) == (10.0, 0.01)


def test_layout_and_rows(spark):
    places = {(r.own, r.opp): (r.x, r.y) for r in diagrams.diamond_layout(spark, diagrams.ROUND_WINS).collect()}
    assert places[5, 5] == (4 * 28 + 64.0, 64.0) and places[1, 5] == (64.0, 4 * 64 + 64.0) and len(places) == 25
    items = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 1)], "g long, i long")
    got = sorted((r.g, r.row, r.i) for r in diagrams.even_rows(items, "g", "i").collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 4), (1, 1, 5), (1, 1, 6), (2, 0, 1)]
    assert spark.range(1).select(diagrams.win_colour(F.lit(0.0)), diagrams.win_colour(F.lit(1.0))).first()[:] == ("#e0554f", "#0ca30c")
    with pytest.raises(LookupError):
        diagrams.exactly_one(items, "item")


def test_shoutouts_are_the_best_of_all_assignments(spark):
    """Against every assignment there is: most players, then the least sum of ranks, then the least worst rank."""
    rng = random.Random(6)
    rows, want = [], {}
    for scope in range(40):
        offers = []
        for k in range(rng.randint(1, 5)):
            players = rng.sample(range(1, 6), rng.randint(1, 4))
            offers.append(list(enumerate(players)))
            rows += [(scope, f"c{k}", k, p, rank) for rank, p in offers[-1]]
        best = None
        for choice in itertools.product(*[[None, *o] for o in offers]):
            taken = [c for c in choice if c]
            if len({p for _, p in taken}) == len(taken):
                key = (-len(taken), sum(r for r, _ in taken), max((r for r, _ in taken), default=0))
                best = key if best is None else min(best, key)
        want[scope] = best
    found = social.assign_shoutouts(spark.createDataFrame(rows, "scope_id long, category string, priority long, player_id long, rank long")).collect()
    for scope, key in want.items():
        mine = [r for r in found if r.scope_id == scope]
        assert len({r.player_id for r in mine}) == len({r.category for r in mine}) == len(mine)
        assert (-len(mine), sum(r["rank"] for r in mine), max((r["rank"] for r in mine), default=0)) == key


def test_matching_settles_ties_by_priority():
    """Against every choice: players, sum, worst rank, then the categories' ranks in order of priority."""
    from roundlens.operators.matching import best_assignment

    rng = random.Random(1)
    for _ in range(400):
        ranks = {}
        for c in range(rng.randint(1, 5)):
            ranks |= {(p, c): r for r, p in enumerate(rng.sample(range(5), rng.randint(0, 4)))}
        last, found = max(ranks.values(), default=0) + 1, []
        for choice in itertools.product(*[[None, *(p for p in range(5) if (p, c) in ranks)] for c in range(5)]):
            given = [(p, c) for c, p in enumerate(choice) if p is not None]
            if len({p for p, _ in given}) == len(given):
                each = [ranks[x] for x in given]
                found.append((-len(each), sum(each), max(each, default=0), tuple(last if p is None else ranks[p, c] for c, p in enumerate(choice)), dict(given)))
        assert best_assignment(ranks) == min(found, key=lambda x: x[:4])[4]
    wide = {(p, c): r for c in range(25) for r, p in enumerate(rng.sample(range(60), 60))}
    assert len(set(best_assignment(wide).values())) == 25 and best_assignment({}) == {}


def test_shoutouts_fall_back(spark):
    """The assigned category, then the best round, then the scope's anchor, then nothing."""
    key = "scope_id long, player_id long, "
    roster = spark.createDataFrame([(1, p) for p in range(1, 5)], "scope_id long, player_id long")
    assigned = spark.createDataFrame([(1, 1, "clutches", 0)], key + "category string, rank long")
    values = spark.createDataFrame([(1, 1, "clutches", 1), (1, 2, "clutches", 1)], key + "category string, value long")
    best = spark.createDataFrame([(1, 1, 9.0), (1, 2, 12.5)], key + "impact double")
    anchors = spark.createDataFrame([(1, 2, "A", "a"), (1, 3, "A", "a")], key + "headline string, detail string")
    got = {r.player_id: (r.headline, r.detail) for r in social.told_shoutouts(roster, assigned, values, best, anchors).collect()}
    assert got == {1: ("Clutch Gene", "1 clutch round won"), 2: ("Highlight Reel", "12 Impact in a single round"), 3: ("A", "a"), 4: ("UH OH", "no category fits")}


def test_session_pages_by_hand(spark):
    """An opponent is MVP of one round, one match has no known side, one round no winner and one was surrendered."""
    from roundlens.operators import rosters

    seats = spark.createDataFrame([(7, 0, 1, 10, 100), (7, 0, 1, 11, 101), (7, 0, 2, 20, 100), (7, 0, 2, 25, 101)], "scope_id long, session long, match_id long, match_player_id long, player_id long")
    sides = spark.createDataFrame([(7, 0, 1, "team-1"), (7, 0, 2, None)], "scope_id long, session long, match_id long, our_team string")
    rounds = spark.createDataFrame([(1, 1, "Team A Elimination Win"), (1, 2, "Team B Defuse Win"), (1, 3, None), (1, 4, "Team B Surrendered Win"), (2, 5, "Team A Elimination Win")], "match_id long, round_id long, outcome string")
    rows = [(1, 1, 10, "team-1", 30.0, 10.0), (1, 1, 11, "team-1", 5.0, 0.0), (1, 1, 15, "team-2", 50.0, 5.0), (1, 2, 10, "team-1", 40.0, 0.0), (1, 2, 11, "team-1", 40.0, 0.0), (1, 2, 15, "team-2", 1.0, 0.0)]
    rows += [(1, 3, 10, "team-1", 8.0, 2.0), (1, 3, 11, "team-1", 9.0, 0.0), (1, 4, 10, "team-1", 99.0, 0.0), (2, 5, 20, "team-1", 60.0, 0.0), (2, 5, 25, "team-2", 0.0, 20.0)]
    impact = spark.createDataFrame([(*r, r[4] - r[5]) for r in rows], "match_id long, round_id long, match_player_id long, team string, kill_impact double, death_impact double, impact double")
    mvps = {r.player_id: (r.mvps, r.best) for r in rosters.session_mvps(seats, impact, rounds).collect()}
    assert mvps == {100: (2, 60.0), 101: (1, 40.0)}  # round 1 went to an opponent, round 2 to the lower seat
    board = {r.player_id: tuple(r)[3:] for r in rosters.session_leaderboard(seats, sides, impact, rounds).collect()}
    assert board[100] == (4, 31.5, 3.0, round((30 - 10 + 0 - 2 + 0) / 4, 6), 1, 1) and board[101] == (4, 8.5, 5.0, round((5 - 20) / 4, 6), 1, 1)


def test_discovery_of_histories(spark):
    from roundlens.sources import ingest

    acts = spark.createDataFrame([(k, datetime.datetime(2024, k, 1)) for k in range(1, 8)], "act_id long, act_start timestamp_ntz")
    rows = [(1, 7, 1, "a", "Competitive"), (1, 7, 2, "b", "Other"), (1, 6, 1, "a", "Competitive"), (1, 5, 1, "c", "Competitive"), (1, 1, 1, "z", "Competitive"), (2, 7, 1, "x", "Competitive"), (2, 7, 2, "y", "Competitive")]
    history = spark.createDataFrame(rows, "player long, act_id long, place long, external_id string, mode string")
    got = sorted(tuple(r) for r in ingest.whole_history(history, acts).collect())
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "x"), (2, 2, "y")]  # acts 4, 3 and 2 are empty: act 1 isn't looked at
    assert ingest.whole_history(history, acts, max_matches=1).count() == 2 and ingest.whole_history(history, acts, max_acts=1).count() == 3
    assert sorted(r.external_id for r in ingest.most_recent(history, 1).collect()) == ["a", "x"]


def test_inserts_of_a_dump(spark, tmp_path):
    from roundlens.sources import ingest

    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO public.impact_scores (id, round_id, match_player_id, kill_impact, death_impact, impact, breakdown) VALUES (1, 2, 3, 4.5, -1, 5.5, '{\"a\": 1, \"who''s\": 2}');\nINSERT INTO public.rounds VALUES (1);\n")
    row = ingest.read_impact_inserts(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(2, 3, 4.5, -1.0, 5.5, {"a": "1", "who's": "2"})]
    new = spark.createDataFrame([({"a": "1", "b": "2"},)], "breakdown map<string,string>")
    assert {r.part: r.state for r in validation.part_names(ingest.read_impact_inserts(spark, str(tmp_path)), new).collect()} == {"a": "kept", "who's": "retired", "b": "added"}


def test_labels(spark):
    from roundlens.functions import text

    row = spark.sql("select 'A#1' n, 'KAY/O' a, timestamp_ntz'2025-10-18 04:08:00' t, cast(null as timestamp_ntz) z").select(
        text.strip_tag(F.col("n")), text.slug(F.col("a")), text.match_label(F.lit("Haven"), F.lit("m1"), F.col("t")), text.match_label(F.lit(None).cast("string"), F.lit("m1"), F.col("z")), text.local_time(F.col("t"), "yyyy-MM-dd"), text.local_time(F.col("z"), "yyyy"), text.percent(F.lit(0.125))
    ).first()
    assert tuple(row) == ("A", "kayo", "Haven 10/17/25 9:08 PM", "m1", "2025-10-17", "", "12%")


def test_bootstrap_of_fight_values_equals_a_plain_one(spark):
    """Draw by draw with Python sums, from the same picks."""
    import numpy as np

    from roundlens.operators import statistics

    rng = random.Random(8)
    wins, duels = [], []
    for m in range(9):
        for own, opp in ((3, 2), (2, 3), (3, 3)):
            n = rng.randint(0, 3)
            wins.append((5, m, "attack", own, opp, n, rng.randint(0, n)))
        duels.append((5, m, "attack", 3, 3, rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 3), rng.randint(0, 3)))
    w, d = fights(spark, wins, duels)
    seats = spark.createDataFrame([(5, m) for m in range(9)], "player_id long, match_id long")
    draws, seed = 300, 2
    got = {(r.pool, r.side, r.own, r.opp): r for r in statistics.fight_ev(w, d, seats, draws, seed).collect()}
    points = {(r.pool, r.side, r.own, r.opp): r for r in replay.fight_points(w, d).collect()}
    for key, r in got.items():
        p = points[key]
        assert (r.n_player, r.n_teammates) == (p.n_player, p.n_teammates)
        for a, b in ((r.p_player, p.p_player), (r.p_teammates, p.p_teammates), (r.m, p.m), (r.leverage, p.leverage)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)
    picks = np.random.default_rng([seed, 5]).integers(0, 9, size=(draws, 9))
    total = lambda rows, own, opp, c, draw: sum(r[c] for m in draw for r in rows if r[1] == m and r[3:5] == (own, opp))
    for pool, c in (("tracked", 7), ("all", 9)):
        values = []
        for draw in picks.tolist():
            k, n, tk, tn = (total(duels, 3, 3, x, draw) for x in (5, 6, c, c + 1))
            e1, w1, e2, w2 = total(wins, 3, 2, 5, draw), total(wins, 3, 2, 6, draw), total(wins, 2, 3, 5, draw), total(wins, 2, 3, 6, draw)
            if k + n and tk + tn and e1 and e2 and w1 / e1 - w2 / e2 > 0:
                values.append((k / (k + n) - tk / (tk + tn)) * (w1 / e1 - w2 / e2))
        cell = got[pool, "attack", 3, 3]
        if cell.leverage is not None and cell.leverage > 0:
            assert cell.defined == len(values) / draws
            low, high = np.percentile(values, [2.5, 97.5])
            assert abs(cell.low - low) < 1e-9 and abs(cell.high - high) < 1e-9


def test_matching_is_solved_twice_unless_a_worse_rank_can_go(monkeypatch):
    from roundlens.operators import matching

    solved = []
    pairs = matching.least_cost_pairs
    monkeypatch.setattr(matching, "least_cost_pairs", lambda costs: solved.append(1) or pairs(costs))
    ranks = {(p, c): (p + c) % 5 for c in range(5) for p in range(5)} | {(5, 5): 4}
    assert len(matching.best_assignment(ranks)) == 6 and len(solved) == 2
