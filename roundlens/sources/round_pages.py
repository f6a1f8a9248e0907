"""Saved round pages of the older site, read with string functions: rounds, loadout bars, event log, players.

Pages come as rows (match, round_number, html). A page is cut at the fixed marks
of the site's markup; a mark that isn't there gives nulls or no rows, and stops no page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ingest import bar_loadout, first_outcome, minutes_seconds, thousands

# The marks in the pages.
STATE_MARK = "<script>window.__INITIAL_STATE__"
ROUND_MARK, BAR_MARK = 'text-12 font-medium text-dim">', '"w-3 bg-valorant-{}" style="height: '
EVENT_MARK, EVENT_TIME = "space-between flex cursor-pointer flex-row items-center", 'text-16 font-medium leading-3/4">'
PLAYER_MARK, NAME_MARK = "st-custom-name st-entry-party st-entry", "trn-ign__username fit-long-username"
VALUE_MARK = "st__item st-content__item-value st-content__item-value--active st__item--align-center"

FIRST_BONUS, BONUS_STEP = 150, 20
KEY = ["match", "round_number"]


def pieces(text: Column, mark: str) -> Column:
    """The text cut at a mark, taken as it is."""
    return F.split(text, re.escape(mark))


def body(html: Column) -> Column:
    """The lines between that of the body tag and the state script, joined, ends of lines trimmed."""
    found = F.regexp_extract(html, r"(?s)<body[^\n]*\n(.*?)(?:\n" + re.escape(STATE_MARK) + r"|\z)", 1)
    return F.regexp_replace(found, r"[ \t\r\f]*(\n|\z)", "")


def round_count(text: Column) -> Column:
    """Rounds of the match: those won by both teams."""
    won = lambda team, k: F.regexp_extract(text, rf'(?s)Team {team}.*?valorant-color-team-{k}">\s*(\d+)', 1)
    return F.when(won("A", 1) != "", won("A", 1).cast("int")) + F.when(won("B", 2) != "", won("B", 2).cast("int"))


def round_facts(pages: DataFrame) -> DataFrame:
    """(match, round_number, rounds, outcome, loadout_1, loadout_2) of each page."""
    rows = pages.select(*KEY, body(F.col("html")).alias("text"))
    rest = F.expr(f"CASE WHEN instr(text, concat('{ROUND_MARK}', round_number, '<')) > 0 THEN substr(text, instr(text, concat('{ROUND_MARK}', round_number, '<'))) END")
    height = lambda k: F.regexp_extract("rest", re.escape(BAR_MARK.format(f"team-{k}")) + r"([0-9.]+)px", 1)
    load = lambda k: F.when(height(k) != "", bar_loadout(height(k).cast("double")))
    return rows.withColumn("rest", rest).select(*KEY, round_count(F.col("text")).alias("rounds"), first_outcome(F.col("text")).alias("outcome"), load(1).alias("loadout_1"), load(2).alias("loadout_2"))


def event_log(pages: DataFrame) -> DataFrame:
    """A row per event of a page's log, in order: kind (Kill, Planted, Exploded, Defused), t, teams and icon numbers of those in it, the weapon's icon, and the bonus of a kill.

    Who fell is read third and second from the end of the entry, else at its
    eighth and ninth, else at its seventh and eighth class. The bonus falls by BONUS_STEP
    with each kill of the same team. weapon is Friendly within a team, and
    Environmental where no weapon is shown.
    """
    log = F.element_at(pieces(F.col("text"), "Event Log"), 2)
    rows = pages.select(*KEY, body(F.col("html")).alias("text")).where(F.size(pieces(F.col("text"), "Event Log")) > 1).select(*KEY, F.posexplode(pieces(log, EVENT_MARK)).alias("place", "entry")).where("place > 0")
    kind = F.when(F.col("entry").contains("Planted"), "Planted").when(F.col("entry").contains("Exploded"), "Exploded").when(F.col("entry").contains("Defused"), "Defused").otherwise("Kill")
    rows = rows.withColumn("kind", kind).withColumn("c", pieces(F.col("entry"), "class")).withColumn("n", F.size("c"))
    clock = F.regexp_extract("entry", re.escape(EVENT_TIME) + r"([^<]*)<", 1)
    part = lambda i: F.get(F.col("c"), i)
    team = lambda x: F.when(x.rlike("valorant-.{6}"), F.regexp_extract(x, r"valorant-(.{6})", 1))
    icon = lambda x: F.when(x.rlike(r"displayicon.*?\.png"), F.regexp_extract(x, r"displayicon(.*?)\.png", 1))
    spots = [(F.col("n") - 3, F.col("n") - 2), (F.lit(8), F.lit(9)), (F.lit(7), F.lit(8))]
    fallen = F.coalesce(*[F.when(team(part(i)).isNotNull() & icon(part(j)).isNotNull(), F.struct(team(part(i)).alias("team"), icon(part(j)).alias("icon"))) for i, j in spots])
    rows = rows.select(*KEY, "place", "kind", F.when(clock != "", minutes_seconds(clock)).alias("t"), team(part(F.lit(1))).alias("team"), icon(part(F.lit(2))).alias("icon"), F.when(F.col("kind") == "Kill", fallen).alias("f"), "entry")
    weapon = F.when(F.col("team") == F.col("f.team"), "Friendly").when(~F.col("entry").contains("newimage"), "Environmental").otherwise(F.regexp_extract("entry", r"newimage(.*?)\.png", 1))
    kill = F.col("kind") == "Kill"
    before = F.count_if(kill).over(Window.partitionBy(*KEY, "team").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(*KEY, "place", "kind", "t", "team", "icon", F.col("f.team").alias("fallen_team"), F.col("f.icon").alias("fallen_icon"), F.when(kill, weapon).alias("weapon"), F.when(kill, FIRST_BONUS - BONUS_STEP * before).alias("bonus"))


def page_players(pages: DataFrame) -> DataFrame:
    """(match, name, agent, team) from the pages of first rounds: the first five entries are of team-1, the next five of team-2."""
    rows = pages.where("round_number = 1").select("match", F.posexplode(pieces(body(F.col("html")), PLAYER_MARK)).alias("place", "entry")).where("place between 1 and 10")
    name = F.regexp_extract("entry", re.escape(NAME_MARK) + r'">([^<]*)<', 1)
    return rows.select("match", name.alias("name"), F.regexp_extract("entry", r'alt="([^"]*)"', 1).alias("agent"), F.when(F.col("place") <= 5, "team-1").otherwise("team-2").alias("team"))


def page_stats(pages: DataFrame) -> DataFrame:
    """(match, round_number, name, score, kills, deaths, assists, loadout, remaining) of each player's line on a page; commas in thousands go."""
    rows = pages.select(*KEY, F.explode(pieces(body(F.col("html")), NAME_MARK)).alias("entry")).where(F.col("entry").contains(VALUE_MARK))
    rows = rows.select(*KEY, F.regexp_extract("entry", r"^..([^<]*)<", 1).alias("name"), pieces(F.element_at(pieces(F.col("entry"), VALUE_MARK), 2), 'value">').alias("v"))
    value = lambda i: thousands(F.regexp_extract(F.get(F.col("v"), F.lit(i)), r"^([^<]*)<", 1))
    left = thousands(F.regexp_extract(F.get(F.col("v"), F.lit(5)), r'label">([^<]*)<', 1))
    return rows.select(*KEY, "name", *[value(i).alias(c) for i, c in enumerate(("score", "kills", "deaths", "assists", "loadout"), 1)], left.alias("remaining"))


def files_of_names(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, files): the files of each name, those of ``known`` first and each once; ``fresh`` has name and file."""
    new = fresh.where("name is not null and file is not null").groupBy("name").agg(F.array_sort(F.collect_set("file")).alias("new"))
    empty = F.array().cast("array<string>")
    return known.join(new, "name", "full").select("name", F.array_union(F.coalesce("files", empty), F.coalesce("new", empty)).alias("files"))
