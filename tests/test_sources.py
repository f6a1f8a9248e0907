"""Pages and dumps as a source with pushed filters and a resumable queue; documents of changing shape as variants."""

import glob
import json
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from roundlens.sources import crawl, ingest, variants


def page(folder, player, act, number, ids, at):
    where = f"{folder}/{player}/{act}"
    os.makedirs(where, exist_ok=True)
    with open(f"{where}/{number}.json", "w") as f:
        json.dump({"data": [{"attributes": {"id": i}, "metadata": {"modeName": "Competitive" if i != "x" else "Other"}} for i in ids] + [{"metadata": {}}]}, f)
    os.utime(f"{where}/{number}.json", ns=(at * 10**9, at * 10**9))


def test_paged_histories(spark, tmp_path):
    folder = str(tmp_path)
    page(folder, "p1", 3, 0, ["a", "b"], 1)
    page(folder, "p1", 3, 1, ["b", "c"], 2)
    page(folder, "p1", 2, 0, ["x"], 3)
    page(folder, "p2", 3, 0, ["a"], 4)
    (tmp_path / "p1" / "notes.json").write_text("{}")
    rows = crawl.paged_history(spark, f"file://{folder}")
    assert sorted((r.player, r.act_id, r.place, r.external_id) for r in rows.collect()) == [("p1", 2, 0, "x"), ("p1", 3, 0, "a"), ("p1", 3, 1, "b"), ("p1", 3, 100000, "b"), ("p1", 3, 100001, "c"), ("p2", 3, 0, "a")]
    some = crawl.paged_history(spark, f"file://{folder}", ["p1"], [3, 9])
    assert some.rdd.getNumPartitions() == 1 and rows.rdd.getNumPartitions() == 3  # the others' files aren't planned
    one, two = rows.where("player = 'p1'").select("place"), rows.where("player = 'p2'").select("place")
    assert one.unionAll(two).count() == two.unionAll(one).count() == 6  # filters of two scans don't mix
    assert sorted(r.external_id for r in some.where("mode = 'Competitive'").collect()) == ["a", "b", "b", "c"]
    acts = spark.createDataFrame([(2, 2), (3, 3)], "act_id long, act_start long")
    assert [r.external_id for r in ingest.whole_history(rows, acts).where("player = 'p1'").orderBy("place").collect()] == ["a", "b", "c"]
    assert crawl.paged_history(spark, f"file://{folder}/none").count() == 0


def test_a_stopped_crawl_reads_each_document_once(spark, tmp_path):
    pages, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    os.makedirs(pages)

    def go():
        query = crawl.crawled_once(spark, f"file://{pages}").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.external_id for r in spark.read.parquet(out).collect())

    page(pages, "p1", 3, 0, ["a", "b"], 10)
    page(pages, "p2", 3, 0, ["b"], 11)
    assert go() == ["a", "b"]
    assert go() == ["a", "b"]
    page(pages, "p1", 3, 1, ["b", "c"], 12)  # pages of old acts and other players come behind what was taken
    page(pages, "p0", 1, 0, ["d", "a"], 13)
    assert go() == ["a", "b", "c", "d"]


def test_inserts_are_cut_by_bytes_and_filtered(spark, tmp_path):
    note = lambda i: "NULL" if i % 3 == 0 else f"'it''s é, ({i})'"
    lines = [f"INSERT INTO public.impact_scores (id, round_id, note) VALUES ({i}, {i * 2}, {note(i)});" for i in range(200)]
    lines += ["-- INSERT INTO nothing", "INSERT INTO rounds VALUES (1, 'x');", "CREATE TABLE y ();"]
    (tmp_path / "d.sql").write_text("\n".join(lines))
    crawl.register(spark)
    for size in (97, 1000, 1 << 20):
        rows = spark.read.format("arena_inserts").option("splitBytes", size).load(f"file://{tmp_path}")
        got = sorted((int(r["values"][0]), r["values"][2]) for r in rows.where("of_table = 'impact_scores'").collect())
        assert got == [(i, None if i % 3 == 0 else f"it's é, ({i})") for i in range(200)]
        assert [(r.columns, r["values"]) for r in rows.where("table = 'rounds'").collect()] == [(None, ["1", "x"])]
    one = crawl.insert_rows(spark, f"file://{tmp_path}", "impact_scores").where("row['id'] = '7'").first().row
    assert one == {"id": "7", "round_id": "14", "note": "it's é, (7)"}


def segment(kind, **more):
    return {"type": kind, **more}


DOC = {
    "attributes": {"id": "m1"},
    "metadata": {"mapName": "Haven", "dateStarted": "2024-05-01T10:00:00Z", "modeName": "Competitive", "new": {"deep": [1, "2"]}},
    "segments": [
        segment("team-summary", attributes={"teamId": "Red"}, stats={"roundsWon": {"value": 13, "rank": None}, "damage": {"value": 9000}}),
        segment("team-summary", attributes={"teamId": "Blue"}, stats={"roundsWon": "7"}),
        segment("player-summary", attributes={"platformUserIdentifier": "A#1", "teamId": "Red"}, metadata={"agentName": "Jett"}),
        segment("player-summary", attributes={"platformUserIdentifier": "B#2", "teamId": "Blue"}, metadata={}),
        segment("round-summary", attributes={"round": "1"}, stats={"plantTime": {"value": "31.5"}}, roundResult="Defuse", winningTeam="Blue"),
        segment("round-summary", attributes={"round": 2}, metadata={"roundResult": "Surrendered", "winningTeam": "Red"}),
        segment("player-round", attributes={"round": 1, "platformUserIdentifier": "A#1"}, stats={"score": "220", "kills": {"value": 2}, "deaths": None}),
        segment("player-round", attributes={"round": 1, "platformUserIdentifier": "ghost"}, stats={}),
        segment("player-round-kills", attributes={"round": 1, "platformUserIdentifier": "A#1", "opponentPlatformUserIdentifier": "B#2"}, metadata={"weaponName": "Vandal", "weaponCategory": "Rifle", "gameTime": "12500"}),
        segment("player-round-kills", attributes={"round": 1, "platformUserIdentifier": "B#2"}, weaponName="Classic", gameTime=13000),
        segment("something-new", stats={"x": 1}),
        "not a segment",
    ],
}


def test_documents_of_changing_shape(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(DOC, indent=1))
    (tmp_path / "in" / "2.json").write_text(json.dumps(DOC))
    (tmp_path / "in" / "3.json").write_text("{broken")
    (tmp_path / "in" / "4.json").write_text(json.dumps({"attributes": {"id": 2}, "segments": None}))
    docs = variants.read_documents(spark, str(tmp_path / "in"))
    landed = variants.land_documents(docs, f"{tmp_path}/landed")
    stored = str(pq.ParquetFile(glob.glob(f"{tmp_path}/landed/*.parquet")[0]).schema)
    assert "typed_value" in stored  # shredded
    for source in (docs, landed):
        t = variants.tables(source)
        rows = {k: [tuple(r) for r in v.drop("stats", "more").collect()] for k, v in t.items()}
        assert sorted(rows["matches"], key=str) == [("2", None, None, None, None, None), ("m1", "Haven", t["matches"].where("external_id = 'm1'").first().played_at, "Competitive", 13, 7)]
        assert sorted(rows["match_players"]) == [("m1", "A#1", "team-1", "Jett"), ("m1", "B#2", "team-2", None)]
        assert rows["rounds"] == [("m1", 1, "Team B Defuse Win", 31.5, None)]
        assert sorted(rows["match_teams"]) == [("m1", "team-1", 13), ("m1", "team-2", 7)]
        assert rows["round_player_stats"] == [("m1", 1, "A#1", 220, 2, 0, 0, 0, 0)]
        assert sorted(rows["kill_events"], key=str) == [("m1", 1, "A#1", "B#2", "Vandal", 12.5), ("m1", 1, "B#2", None, "Classic", 13.0)]
        assert t["match_teams"].select(F.try_variant_get("stats", "$.damage.value", "int").alias("d")).where("d is not null").first().d == 9000
        assert t["kill_events"].select(F.try_variant_get("more", "$.weaponCategory", "string").alias("c")).where("c is not null").first().c == "Rifle"
    assert all(t.count() == 0 for t in variants.tables(docs.limit(0)).values())
