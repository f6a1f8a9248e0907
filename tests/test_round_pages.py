"""Saved round pages, cut at the site's marks, from hand-made pages."""

from pyspark.sql import functions as F

from roundlens.sources import round_pages as R

CELL = R.VALUE_MARK


def entry(time, *classes, extra=""):
    return f'<div {R.EVENT_MARK} x><b {R.EVENT_TIME}{time}</b>{extra}' + "".join(f'<i class="{c}">' for c in classes)


def page(number):
    players = "".join(f'<div {R.PLAYER_MARK} ><img alt="Agent{i}"><a {R.NAME_MARK}">name{i}</a></div>' for i in range(1, 11))
    stats = f'<a {R.NAME_MARK}">name1</a><td {CELL}><b value">1,250</b><b value">2</b><b value">0</b><b value">1</b><b value">3,900</b><i label">1,050</i></td>'
    kill = entry("0:42", "valorant-team-1 a", "displayicon7.png", "gun newimage3.png", "x", "valorant-team-2 b", "displayicon9.png", "tail")
    again = entry("1:02", "valorant-team-1 a", "displayicon.png", "valorant-team-2 b", "displayicon8.png", "tail")
    plant = entry("0:50", "valorant-team-1 a", "displayicon7.png", extra="Planted")
    bars = f'{R.ROUND_MARK}{number}<b><i class={R.BAR_MARK.format("team-1")}4.0px"></i><i class={R.BAR_MARK.format("team-2")}0.5px"></i>'
    text = f'Team A <b valorant-color-team-1">13</b> Team B <b valorant-color-team-2">7</b>\nTeam B Defuse Win  \n{bars}\n{players}{stats}\nEvent Log{kill}{plant}{again}'
    return f"<html>\nnot this Team A Time Win\n<body class='x'>\n{text}\n{R.STATE_MARK} = 1 Team A</script>"


def test_pages(spark):
    df = spark.createDataFrame([("m", 1, page(1)), ("m", 2, page(2)), ("n", 1, None), ("n", 2, "<body>\nnothing")], "match string, round_number int, html string")
    facts = {(r.match, r.round_number): r for r in R.round_facts(df).collect()}
    assert facts["m", 2][2:] == (20, "Team B Defuse Win", 2500, 312) and facts["n", 2][2:] == facts["n", 1][2:] == (None, None, None, None)
    log = R.event_log(df).where("round_number = 1").orderBy("place").collect()
    assert [(r.kind, r.t, r.team, r.icon, r.fallen_team, r.fallen_icon, r.weapon, r.bonus) for r in log] == [
        ("Kill", 42, "team-1", "7", "team-2", "9", "3", 150), ("Planted", 50, "team-1", "7", None, None, None, None), ("Kill", 62, "team-1", "", "team-2", "8", "Environmental", 130),
    ]
    players = R.page_players(df).collect()
    assert len(players) == 10 and [(r.name, r.agent, r.team) for r in players][4:6] == [("name5", "Agent5", "team-1"), ("name6", "Agent6", "team-2")]
    assert [tuple(r)[2:] for r in R.page_stats(df).where("round_number = 2").collect()] == [("name1", 1250, 2, 0, 1, 3900, 1050)]


def test_files_of_names(spark):
    known = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "name string, files array<string>")
    fresh = spark.createDataFrame([("a", "y"), ("a", "w"), ("c", "v"), (None, "u")], "name string, file string")
    assert {r.name: r.files for r in R.files_of_names(known, fresh).collect()} == {"a": ["x", "y", "w"], "b": ["z"], "c": ["v"]}
    assert R.files_of_names(known, fresh.where(F.lit(False))).count() == 2


def test_tables_of_a_database(spark):
    """A table written to an embedded database and read again in ranges of its key."""
    import pytest

    from roundlens.sources import ingest

    url = "jdbc:derby:memory:arena;create=true"
    try:
        spark.range(100).select((F.col("id") * 3).alias("ID"), F.col("id").cast("string").alias("NAME")).write.jdbc(url, "ARENA_SCORES", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    except Exception as error:
        pytest.skip(f"no embedded database here: {error}")
    got = ingest.read_jdbc(spark, url, "ARENA_SCORES", "ID", 0, 300, 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert got.rdd.getNumPartitions() == 4 and sorted(r.ID for r in got.collect()) == [3 * i for i in range(100)]


def test_upsert_by_match(spark, tmp_path, monkeypatch):
    from roundlens.sources import ingest

    monkeypatch.setattr(ingest, "MATCHES_A_PART", 10)
    path = str(tmp_path / "impact")
    rows = lambda *x: spark.createDataFrame(list(x), "match_id long, impact long")
    ingest.upsert_by_match(rows((1, 1), (1, 2), (2, 3), (15, 4)), path)
    ingest.upsert_by_match(rows((1, 9), (25, 5)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("match_id", "impact").collect()) == [(1, 9), (2, 3), (15, 4), (25, 5)]
