"""Strings for people: names without tags, slugs, labels of matches, plurals, shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISPLAY_ZONE = "America/Los_Angeles"


def strip_tag(name: Column) -> Column:
    """A display name without what follows its first #."""
    return F.split_part(name, F.lit("#"), F.lit(1))


def slug(name: Column) -> Column:
    """A name as part of a file name: no slashes, lower case; null for an empty one."""
    return F.when(name != "", F.lower(F.replace(name, F.lit("/"), F.lit(""))))


def plural(value: Column) -> Column:
    return F.when(value == 1, "").otherwise("s")


def percent(share: Column) -> Column:
    """A share as whole percent; a dash where there is none."""
    return F.coalesce(F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%")), F.lit("-"))


def local_time(utc: Column, pattern: str, zone: str = DISPLAY_ZONE) -> Column:
    """A UTC time without zone, as text in the display zone; empty for null."""
    return F.coalesce(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), pattern), F.lit(""))


def match_label(map_name: Column, external_id: Column, played_at: Column, zone: str = DISPLAY_ZONE) -> Column:
    """The map, or else the id, and when it was played there: Haven 10/17/25 9:08 PM."""
    name = F.coalesce(F.when(map_name != "", map_name), external_id)
    return F.when(played_at.isNull(), name).otherwise(F.concat(name, F.lit(" "), local_time(played_at, "MM/dd/yy h:mm a", zone)))
