"""Ordered replays of a round's feed, each with its own rules for who is alive.

Rows are numbered by (time, id) within the round; counts before a row are running
sums over that order, as windows, and the canonical replay folds a round's rows as an
array. Both are of one round, so nothing grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import TEAM_1, TEAM_2, attacking_team, other_team, r6, rate, terminal_cause, winner
from ..sources.tables import as_it_lies, written
from .impact import with_teams

ROUND = ["match_id", "round_id"]
_BEFORE, _UPTO = -1, 0


def _n(flag: Column, last: int) -> Column:
    """How often the flag held in the round's rows before this one, or up to it."""
    window = Window.partitionBy(*ROUND).orderBy("seq").rowsBetween(Window.unboundedPreceding, last)
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(window), F.lit(0))


def count_replay(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """The feed with alive_1 and alive_2 before each row, every death row counting, up to the row that empties a side."""
    size = match_players.groupBy("match_id").agg(F.count_if(F.col("team") == TEAM_1).alias("size_1"), F.count_if(F.col("team") == TEAM_2).alias("size_2"))
    rows = with_teams(feed, match_players).join(size, "match_id")
    d1, d2 = F.coalesce(F.col("victim_team") == TEAM_1, F.lit(False)), F.coalesce(F.col("victim_team") == TEAM_2, F.lit(False))
    rows = rows.withColumn("alive_1", F.col("size_1") - _n(d1, _BEFORE)).withColumn("alive_2", F.col("size_2") - _n(d2, _BEFORE))
    return rows.where(((F.col("alive_1") > 0) & (F.col("alive_2") > 0)) | (F.col("seq") == 1)).drop("size_1", "size_2")


def state_wins(feed: DataFrame, rounds: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_id, team, own, opp, wins, total): how often each side won from each man-advantage state before an elimination."""
    rows = count_replay(feed, match_players).join(rounds.select(*ROUND, winner(F.col("outcome")).alias("winner")), ROUND).where("winner is not null and alive_1 >= 1 and alive_2 >= 1")
    both = rows.select("match_id", "winner", F.explode(F.array(F.struct(F.lit(TEAM_1).alias("team"), F.col("alive_1").alias("own"), F.col("alive_2").alias("opp")), F.struct(F.lit(TEAM_2).alias("team"), F.col("alive_2").alias("own"), F.col("alive_1").alias("opp")))).alias("s"))
    return both.groupBy("match_id", "s.team", "s.own", "s.opp").agg(F.count_if(F.col("winner") == F.col("s.team")).alias("wins"), F.count("*").alias("total"))


def diamond(wins: DataFrame) -> DataFrame:
    """All 25 states of both sides taken together, those never seen included, with the rate of wins."""
    spark = wins.sparkSession
    grid = spark.range(1, 6).select(F.col("id").alias("own")).withColumn("opp", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    sums = wins.groupBy("own", "opp").agg(F.sum("wins").alias("w"), F.sum("total").alias("n"))
    return grid.join(sums, ["own", "opp"], "left").select("own", "opp", F.coalesce("w", F.lit(0)).alias("wins"), F.coalesce("n", F.lit(0)).alias("total"), r6(rate(F.col("w"), F.col("n"))).alias("win_rate"))


def player_diagram(feed: DataFrame, rounds: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_player_id, own, opp, wins, total): the states a player was alive in, by own and other side."""
    rows = count_replay(feed, match_players).join(rounds.select(*ROUND, winner(F.col("outcome")).alias("winner")), ROUND).where("winner is not null and alive_1 >= 1 and alive_2 >= 1")
    died = feed.groupBy("match_id", "round_id", F.col("victim").alias("match_player_id")).agg(F.min("seq").alias("died"))
    each = rows.select(*ROUND, "seq", "winner", "alive_1", "alive_2").join(match_players.select("match_id", "match_player_id", "team"), "match_id").join(died, [*ROUND, "match_player_id"], "left")
    each = each.where(F.col("died").isNull() | (F.col("died") >= F.col("seq")))
    one = F.col("team") == TEAM_1
    own, opp = F.when(one, F.col("alive_1")).otherwise(F.col("alive_2")), F.when(one, F.col("alive_2")).otherwise(F.col("alive_1"))
    return each.groupBy("match_player_id", own.alias("own"), opp.alias("opp")).agg(F.count_if(F.col("winner") == F.col("team")).alias("wins"), F.count("*").alias("total"))


def order_edges(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_player_id, own, opp, kills, deaths) by the state before each elimination, seen from the player's side."""
    rows = count_replay(feed, match_players).where("alive_1 >= 1 and alive_2 >= 1 and killer <> victim")
    state = lambda team: (F.when(team == TEAM_1, F.col("alive_1")).otherwise(F.col("alive_2")).alias("own"), F.when(team == TEAM_1, F.col("alive_2")).otherwise(F.col("alive_1")).alias("opp"))
    k = rows.select(F.col("killer").alias("match_player_id"), *state(F.col("killer_team")), F.lit(1).alias("k"), F.lit(0).alias("d"))
    d = rows.select(F.col("victim").alias("match_player_id"), *state(F.col("victim_team")), F.lit(0), F.lit(1))
    return k.unionAll(d).groupBy("match_player_id", "own", "opp").agg(F.sum("k").alias("kills"), F.sum("d").alias("deaths"))


def set_replay(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """The feed with alive_1 and alive_2 before and left_1 and left_2 after each row; a player's first death counts, up to the row that empties a side."""
    rows = with_teams(feed, match_players)
    first = F.row_number().over(Window.partitionBy(*ROUND, "victim").orderBy("seq")) == 1
    rows = rows.withColumn("first_death", first & F.col("victim").isNotNull())
    size = match_players.groupBy("match_id").agg(F.count_if(F.col("team") == TEAM_1).alias("size_1"), F.count_if(F.col("team") == TEAM_2).alias("size_2"))
    rows = rows.join(size, "match_id")
    for k, team in ((1, TEAM_1), (2, TEAM_2)):
        out = F.coalesce(F.col("first_death") & (F.col("victim_team") == team), F.lit(False))
        rows = rows.withColumn(f"alive_{k}", F.col(f"size_{k}") - _n(out, _BEFORE)).withColumn(f"left_{k}", F.col(f"size_{k}") - _n(out, _UPTO))
    return rows.where(((F.col("alive_1") > 0) & (F.col("alive_2") > 0)) | (F.col("seq") == 1)).drop("size_1", "size_2")


def kill_streaks(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, replayed: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(match_player_id, streak): the most eliminations without an own death in between, across the rounds of a match. A gaps-and-islands count.

    Here and below ``replayed`` is set_replay where it was written already. ``more`` are keys that the player implies, which stay in the rows.
    """
    rows = (set_replay(feed, match_players) if replayed is None else replayed).join(rounds.select(*ROUND, "round_number"), ROUND)
    k = rows.where("killer is not null").select("match_id", F.col("killer").alias("p"), "round_number", "seq", F.lit(0).alias("step"), F.lit(1).alias("k"), F.lit(0).alias("d"))
    d = rows.where("victim is not null").select("match_id", F.col("victim").alias("p"), "round_number", "seq", F.lit(1).alias("step"), F.lit(0).alias("k"), F.lit(1).alias("d"))
    island = F.coalesce(F.sum("d").over(Window.partitionBy("match_id", "p").orderBy("round_number", "seq", "step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = k.unionAll(d).withColumn("island", island).groupBy("match_id", "p", "island").agg(F.sum("k").alias("n"))
    return each.groupBy(*more, F.col("p").alias("match_player_id")).agg(F.max("n").alias("streak"))


def clutches(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """(match_id, round_id, team, own, opp, seq): won rounds in which a side of one or two faced as many or more; its smallest state, the first of equals."""
    rows = (set_replay(feed, match_players) if replayed is None else replayed).join(rounds.select(*ROUND, winner(F.col("outcome")).alias("team")), ROUND).where("team is not null")
    one = F.col("team") == TEAM_1
    own, opp = F.when(one, F.col("left_1")).otherwise(F.col("left_2")), F.when(one, F.col("left_2")).otherwise(F.col("left_1"))
    states = rows.select(*ROUND, "team", "seq", own.alias("own"), opp.alias("opp")).where("own in (1, 2) and opp >= own")
    return states.groupBy(*ROUND, "team").agg(F.min(F.struct("own", "seq", "opp")).alias("s")).select(*ROUND, "team", "s.own", "s.opp", "s.seq")


def first_deaths_in_losses(feed: DataFrame, rounds: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_player_id, n): rounds lost in which a player was the first of the own side to fall."""
    rows = with_teams(feed, match_players).where("victim_team is not null")
    first = rows.groupBy(*ROUND, "victim_team").agg(F.min_by("victim", "seq").alias("match_player_id"))
    lost = first.join(rounds.select(*ROUND, winner(F.col("outcome")).alias("winner")), ROUND).where("winner is not null and winner <> victim_team")
    return lost.groupBy("match_player_id").agg(F.count("*").alias("n"))


#: An elimination or return in the canonical replay, and with the state before and after it.
EVENT = "seq:bigint,kill_id:bigint,t:double,killer:bigint,victim:bigint,revived:bigint,killer_team:string,victim_team:string,revived_team:string"
MOVE = f"event:struct<{EVENT}>,alive_1:bigint,alive_2:bigint,left_1:bigint,left_2:bigint,wrong:boolean"


def round_events(feed: DataFrame, match_players: DataFrame) -> DataFrame:
    """(match_id, round_id, events): a round's feed in one array of EVENT, in the order of seq; teams are null for players who aren't of the match.

    A row with revived, a player who comes back, is no casualty, whatever else it says. The
    feed meets its match's seats by match alone, in the order that both lie in.
    """
    if "revived" not in feed.columns:
        feed = feed.withColumn("revived", F.lit(None).cast("long"))
    seats = match_players.groupBy("match_id").agg(F.collect_list(F.struct("match_player_id", "team")).alias("seats")).select("match_id", F.col("seats.match_player_id").alias("ids"), F.transform("seats", lambda x: x["team"]).alias("teams"))
    casualty = lambda c: F.when(F.col("revived").isNull(), F.col(c)).alias(c)
    rows = feed.select(*ROUND, "seq", "kill_id", "t", casualty("killer"), casualty("victim"), "revived").join(as_it_lies(seats), "match_id", "left")
    team = lambda who: F.get("teams", F.array_position("ids", F.col(who)).cast("int") - 1).alias(f"{who}_team")
    players = ("killer", "victim", "revived")
    event = F.struct("seq", "kill_id", "t", *players, *[team(p) for p in players]).cast(f"struct<{EVENT}>")
    return rows.select(*ROUND, event.alias("e")).groupBy(*ROUND).agg(F.sort_array(F.collect_list("e")).alias("events"))


def replayed_rounds(feed: DataFrame, rounds: DataFrame, match_players: DataFrame) -> DataFrame:
    """A row per round: match_id, round_id, round_number, winner, the reason why it can't be replayed, the first that holds, or null, and if it can, the numbers of live and late rows and of duels, and its moves.

    moves: an array of MOVE, the casualties and returns up to the deciding one. All players
    stand at first; one who fell is gone until coming back. A round's few rows are folded
    in order, so nothing is dealt, and no row is computed twice.
    """
    cause = terminal_cause(F.col("outcome"))
    terminal = F.when(cause == "DEFUSE", F.col("defuse_time")).when(cause == "DETONATE", F.col("plant_time") + 45)
    rows = rounds.join(as_it_lies(round_events(feed, match_players)), ROUND, "left").select(
        *ROUND, "round_number", "outcome", winner(F.col("outcome")).alias("winner"), cause.alias("cause"), terminal.alias("terminal"), F.coalesce("events", F.array().cast(f"array<struct<{EVENT}>>")).alias("events")
    )
    stranger = lambda e: (e["killer"].isNotNull() & e["killer_team"].isNull()) | (e["victim"].isNotNull() & e["victim_team"].isNull())
    fallen = F.transform(F.filter("events", lambda e: e["victim"].isNotNull()), lambda e: e["t"])
    reason = (
        F.when(F.coalesce(F.col("outcome").like("%Surrendered Win"), F.lit(False)), "surrendered")
        .when(F.col("winner").isNull(), "unknown_winner")
        .when(F.exists("events", stranger), "unknown_team_membership")
        .when(attacking_team(F.col("round_number")).isNull(), "overtime_unknown_side")
        .when(F.col("cause").isNull(), "unrecognized_round_result")
        .when(F.col("cause").isin("DEFUSE", "DETONATE") & F.col("terminal").isNull(), "missing_terminal_time")
        .when(F.size(fallen) != F.size(F.filter(F.array_distinct(fallen), lambda t: t.isNotNull())), "equal_time_ambiguity")
    )

    def step(so_far: Column, e: Column) -> Column:
        has = lambda who: F.coalesce(F.array_contains(so_far["gone"], e[who]), F.lit(False))
        fell, back = e["victim"].isNotNull() & ~has("victim"), has("revived")
        change = lambda team: F.when(fell & (e["victim_team"] == team), -1).when(back & (e["revived_team"] == team), 1).otherwise(0)
        left_1, left_2 = so_far["left_1"] + change(TEAM_1), so_far["left_2"] + change(TEAM_2)
        wiped = (F.col("cause") == "ELIMINATION") & e["victim"].isNotNull() & ((left_1 == 0) | (left_2 == 0))
        wrong = (e["victim"].isNotNull() & has("victim")) | (F.coalesce(e["killer"] != e["victim"], F.lit(False)) & has("killer"))
        move = F.struct(e.alias("event"), so_far["left_1"].alias("alive_1"), so_far["left_2"].alias("alive_2"), left_1.alias("left_1"), left_2.alias("left_2"), wrong.alias("wrong"))
        gone = F.when(fell, F.array_append(so_far["gone"], e["victim"])).when(back, F.array_remove(so_far["gone"], e["revived"])).otherwise(so_far["gone"])
        after = F.struct(gone.alias("gone"), left_1.alias("left_1"), left_2.alias("left_2"), wiped.alias("decided"), F.array_append(so_far["moves"], move).alias("moves"))
        return F.when(so_far["decided"], so_far).otherwise(after)

    five = F.lit(5).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("gone"), five.alias("left_1"), five.alias("left_2"), F.lit(False).alias("decided"), F.array().cast(f"array<struct<{MOVE}>>").alias("moves"))
    inside = F.filter("events", lambda e: (e["victim"].isNotNull() | e["revived_team"].isNotNull()) & (F.col("terminal").isNull() | (e["t"] < F.col("terminal"))))
    rows = rows.withColumn("reason", reason).withColumn("end", F.when(F.col("reason").isNull(), F.aggregate(inside, start, step)))
    last = F.element_at("end.moves", -1)["event"]["seq"]
    late = F.when(F.col("end.decided"), F.size(F.filter("events", lambda e: e["seq"] > last))).otherwise(F.size(F.filter("events", lambda e: (e["seq"] > 0) & (e["t"] >= F.col("terminal")))))
    rows = rows.select(*ROUND, "round_number", "winner", F.coalesce("reason", F.when(F.exists("end.moves", lambda m: m["wrong"]), "ambiguous_lifecycle")).alias("reason"), F.col("end.moves").alias("moves"), late.cast("long").alias("late"))
    ok = lambda c: F.when(F.col("reason").isNull(), c)
    duel = lambda m: m["event"]["killer_team"] != m["event"]["victim_team"]
    return rows.select(*ROUND, "round_number", "winner", "reason", ok(F.size("moves").cast("long")).alias("live"), ok(F.size(F.filter("moves", duel)).cast("long")).alias("duels"), ok(F.col("late")).alias("late"), ok(F.col("moves")).alias("moves"))


def round_diagnostics(replayed: DataFrame) -> DataFrame:
    """(match_id, round_id, reason, entries, duels, post_decision) of replayed_rounds."""
    return replayed.select(*ROUND, "reason", (F.col("live") + 1).alias("entries"), "duels", F.col("late").alias("post_decision"))


def round_moves(replayed: DataFrame) -> DataFrame:
    """The moves of replayed_rounds, a row each."""
    rows = replayed.select(*ROUND, "round_number", "winner", F.explode("moves").alias("m")).select(*ROUND, "round_number", "winner", "m.event.*", "m.alive_1", "m.alive_2", "m.left_1", "m.left_2")
    return rows.withColumn("duel", F.coalesce(F.col("killer_team") != F.col("victim_team"), F.lit(False)))


def canonical_replay(feed: DataFrame, rounds: DataFrame, match_players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, transitions).

    diagnostics: one row per round: reason (ambiguous_lifecycle among them; null if accepted), entries, duels, post_decision.
    transitions: the accepted rounds' casualties and returns up to the deciding one, with the state before and after each.

    A feed may have revived, a player of a row who comes back; such a row is no
    casualty, whatever else it says. Players outside the match change no state.
    """
    found = replayed_rounds(feed, rounds, match_players)
    return round_diagnostics(found), round_moves(found)


def fight_blocks(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """(match_id, side, own, opp, entries, wins, kills, deaths) of accepted rounds, seen by the attacking and the defending side.

    Here and below ``replayed`` is replayed_rounds where it was written already.
    """
    moves = round_moves(replayed_rounds(feed, rounds, match_players) if replayed is None else replayed)
    attack = attacking_team(F.col("round_number"))
    sides = F.explode(F.array(F.lit("attack"), F.lit("defend"))).alias("side")
    moves = moves.select("*", sides).withColumn("team", F.when(F.col("side") == "attack", attack).otherwise(other_team(attack)))
    one = F.col("team") == TEAM_1
    own, opp = F.when(one, F.col("alive_1")).otherwise(F.col("alive_2")), F.when(one, F.col("alive_2")).otherwise(F.col("alive_1"))
    return moves.groupBy("match_id", "side", own.alias("own"), opp.alias("opp")).agg(
        F.count("*").alias("entries"), F.count_if(F.col("winner") == F.col("team")).alias("wins"), F.count_if(F.col("duel") & (F.col("killer_team") == F.col("team"))).alias("kills"), F.count_if(F.col("duel") & (F.col("victim_team") == F.col("team"))).alias("deaths"),
    )


def player_fight_blocks(feed: DataFrame, rounds: DataFrame, match_players: DataFrame, roster: DataFrame, replayed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(wins, duels) of accepted rounds for each player and match, the player's team being ``own``.

    wins (player_id, match_id, side, own, opp, entries, wins): states that were
    entered, the opening one and that after each casualty. duels (player_id,
    match_id, side, own, opp, and kills and deaths of the player, of tracked
    teammates (in ``roster``: player_id) and of all teammates, as player_kills,
    tracked_kills, all_kills and so on).
    """
    replayed = written(replayed_rounds(feed, rounds, match_players), "replayed") if replayed is None else replayed  # used twice below
    moves = round_moves(replayed)
    five = F.lit(5).cast("long")
    entered = F.concat(F.array(F.struct(five.alias("s_1"), five.alias("s_2"))), F.transform("moves", lambda m: F.struct(m["left_1"].alias("s_1"), m["left_2"].alias("s_2"))))
    states = replayed.where("reason is null").select(*ROUND, "round_number", "winner", F.explode(entered).alias("s")).select(*ROUND, "round_number", "winner", "s.*")

    def seen(rows, one, two):
        """``rows`` from both teams' view, with side, own and opp."""
        rows = rows.withColumn("team", F.explode(F.array(F.lit(TEAM_1), F.lit(TEAM_2))))
        first = F.col("team") == TEAM_1
        own, opp = F.when(first, F.col(one)).otherwise(F.col(two)), F.when(first, F.col(two)).otherwise(F.col(one))
        side = F.when(F.col("team") == attacking_team(F.col("round_number")), "attack").otherwise("defend")
        return rows.select("*", side.alias("side"), own.cast("long").alias("own"), opp.cast("long").alias("opp"))

    state = ["match_id", "team", "side", "own", "opp"]
    seats = match_players.where("player_id is not null").select("match_id", "team", "match_player_id", "player_id")
    wins = seen(states, "s_1", "s_2").groupBy(*state).agg(F.count("*").alias("entries"), F.count_if(F.col("winner") == F.col("team")).alias("wins"))
    wins = wins.join(seats, ["match_id", "team"]).select("player_id", "match_id", "side", "own", "opp", "entries", "wins")
    kill = F.col("killer_team") == F.col("team")
    fought = seen(moves.where("duel"), "alive_1", "alive_2").withColumn("actor", F.when(kill, F.col("killer")).otherwise(F.col("victim")))
    fought = fought.groupBy(*state, "actor").agg(F.count_if(kill).alias("kills"), F.count_if(~kill).alias("deaths"))
    tracked = roster.select("player_id").where("player_id is not null").distinct().withColumn("tracked", F.lit(True))
    actors = match_players.select("match_id", F.col("match_player_id").alias("actor"), "player_id").join(tracked, "player_id", "left").select("match_id", "actor", F.coalesce("tracked", F.lit(False)).alias("tracked"))
    pairs = fought.join(actors, ["match_id", "actor"]).join(seats, ["match_id", "team"])
    mine = F.col("actor") == F.col("match_player_id")
    sums = [F.sum(F.when(on, F.col(c)).otherwise(0)).alias(f"{pool}_{c}") for pool, on in (("player", mine), ("tracked", ~mine & F.col("tracked")), ("all", ~mine)) for c in ("kills", "deaths")]
    return wins, pairs.groupBy("player_id", "match_id", "side", "own", "opp").agg(*sums)


def fight_points(wins: DataFrame, duels: DataFrame) -> DataFrame:
    """A row per player, pool of teammates, side and state: rates and numbers of duels, the win rates after a kill and a death, leverage, m and its state.

    Of player_fight_blocks. m = (p_player - p_teammates) * (w_u - w_d). A side
    without opponents has won when attacking, and one without players has lost
    when defending; all other rates are counted. 2 pools x 2 sides x 25 states a player, so
    the four views of a player are one table.
    """
    w = wins.groupBy("player_id", "side", "own", "opp").agg(F.sum("entries").alias("entries"), F.sum("wins").alias("wins")).select("player_id", "side", "own", "opp", rate(F.col("wins"), F.col("entries")).alias("w"))
    counts = [f"{p}_{c}" for p in ("player", "tracked", "all") for c in ("kills", "deaths")]
    d = duels.groupBy("player_id", "side", "own", "opp").agg(*[F.sum(c).alias(c) for c in counts])
    five = F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))
    cells = wins.select("player_id").distinct().withColumn("side", F.explode(F.array(F.lit("attack"), F.lit("defend")))).withColumn("own", F.explode(five)).withColumn("opp", F.explode(five))
    up, down = w.select("player_id", "side", "own", (F.col("opp") + 1).alias("opp"), F.col("w").alias("up")), w.select("player_id", "side", (F.col("own") + 1).alias("own"), "opp", F.col("w").alias("down"))
    key = ["player_id", "side", "own", "opp"]
    cells = cells.join(up, key, "left").join(down, key, "left").join(d, key, "left").fillna(0, counts)
    cells = cells.withColumn("w_u", F.when((F.col("side") == "attack") & (F.col("opp") == 1), 1.0).otherwise(F.col("up"))).withColumn("w_d", F.when((F.col("side") == "defend") & (F.col("own") == 1), 0.0).otherwise(F.col("down")))
    pools = F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.col(f"{p}_kills").alias("k"), F.col(f"{p}_deaths").alias("d")) for p in ("tracked", "all")])).alias("t")
    rows = cells.select("*", pools).withColumn("n_player", F.col("player_kills") + F.col("player_deaths")).withColumn("n_teammates", F.col("t.k") + F.col("t.d"))
    rows = rows.withColumn("p_player", rate(F.col("player_kills"), F.col("n_player"))).withColumn("p_teammates", rate(F.col("t.k"), F.col("n_teammates")))
    known = F.col("p_player").isNotNull() & F.col("p_teammates").isNotNull() & F.col("w_u").isNotNull() & F.col("w_d").isNotNull()
    leverage = F.when(known, F.col("w_u") - F.col("w_d"))
    m = F.when(leverage > 0, (F.col("p_player") - F.col("p_teammates")) * leverage)
    state = F.when(~known, "NO_DATA").when(leverage <= 0, "NON_POSITIVE_LEVERAGE").otherwise("POSITIVE")
    return rows.select(
        "player_id", "t.pool", "side", "own", "opp", r6(F.col("p_player")).alias("p_player"), "n_player", r6(F.col("p_teammates")).alias("p_teammates"), "n_teammates",
        r6(F.col("w_u")).alias("w_u"), r6(F.col("w_d")).alias("w_d"), r6(leverage).alias("leverage"), r6(m).alias("m"), state.alias("state"),
    )


def fight_leverage(blocks: DataFrame) -> DataFrame:
    """(side, own, opp, win_rate, kill_rate, leverage, status) over all 2 x 25 states; outside the grid a side without opponents has won and one without players has lost."""
    spark = blocks.sparkSession
    sums = blocks.groupBy("side", "own", "opp").agg(*[F.sum(c).alias(c) for c in ("entries", "wins", "kills", "deaths")])
    grid = spark.range(0, 6).select(F.col("id").alias("own")).withColumn("opp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("side", F.explode(F.array(F.lit("attack"), F.lit("defend"))))
    w = grid.join(sums, ["side", "own", "opp"], "left").withColumn("w", F.when((F.col("opp") == 0) & (F.col("side") == "attack"), 1.0).when((F.col("own") == 0) & (F.col("side") == "defend"), 0.0).otherwise(rate(F.col("wins"), F.col("entries"))))
    up = w.select("side", "own", (F.col("opp") + 1).alias("opp"), F.col("w").alias("w_up"))
    down = w.select("side", (F.col("own") + 1).alias("own"), "opp", F.col("w").alias("w_down"))
    cells = w.where("own >= 1 and opp >= 1").join(up, ["side", "own", "opp"], "left").join(down, ["side", "own", "opp"], "left")
    leverage = F.col("w_up") - F.col("w_down")
    status = F.when(leverage.isNull() | (F.coalesce(F.col("kills") + F.col("deaths"), F.lit(0)) == 0), "NO_DATA").when(leverage <= 0, "NON_POSITIVE_LEVERAGE").otherwise("OK")
    return cells.select("side", "own", "opp", r6(F.col("w")).alias("win_rate"), r6(rate(F.col("kills"), F.col("kills") + F.col("deaths"))).alias("kill_rate"), r6(leverage).alias("leverage"), status.alias("status"))
