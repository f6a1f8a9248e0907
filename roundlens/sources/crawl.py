"""Crawled pages and dumps as a Spark source, read in batches or as a resumable stream.

``format("arena_pages")`` reads paged histories: files ``<player>/<act>/<page>.json``
below the path, each ``{"data": [{"attributes": {"id": ..}, "metadata": {"modeName":
..}}, ..]}``. A partition is the pages of one player and act; pushed filters on
of_player and of_act choose among them before a file is opened.

``format("arena_inserts")`` reads the INSERT lines of dumps: the table, its columns and
the values as texts. A partition is a range of bytes of a file; a pushed filter on
of_table leaves other lines unparsed.

Spark (4.1) keeps the last pushed filters for all scans of one ``load()``, so only
these columns, which the functions below filter once and then drop, are ever pushed
down: a reader's own filters on player, act_id and table stay with Spark.

As streams both take files as a queue, in order of their time and name: an offset is
the last file taken, so that a query which is stopped goes on behind it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
INSERT = re.compile(r"^INSERT INTO (?:\w+\.)?(\w+)\s*(?:\(([^)]*)\))?\s*VALUES\s*\(")
SPLIT_BYTES = 32 << 20


class Taken(NamedTuple):
    """A file of the queue: its time, then its path."""

    time: int
    path: str


class Files:
    """The files of a path on any file system that Arrow knows; all executors must reach it."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def queue(self, suffix: str) -> list[tuple[Taken, int]]:
        """(file, bytes) in order of time and path."""
        found = self.system.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return sorted((Taken(int(f.mtime_ns or 0), f.path), f.size) for f in found if f.is_file and f.path.endswith(suffix))

    def read(self, path: str, start: int = 0, size: int | None = None) -> bytes:
        with self.system.open_input_file(path) as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)


def _wanted(filters: list[Filter], columns: dict[str, type]) -> dict[str, set]:
    """Values that equality filters leave for ``columns``. Spark is told to apply all filters again, so these only save reading."""
    wanted: dict[str, set] = {}
    for f in filters:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if name in columns and values is not None:
            values = {columns[name](v) for v in values if v is not None}
            wanted[name] = wanted[name] & values if name in wanted else values
    return wanted


class Pages(InputPartition):
    def __init__(self, player: str, act: int, paths: list[str]):
        self.player, self.act, self.paths = player, act, paths


class PageReader(DataSourceReader):
    schema_ddl = "player string, act_id long, page long, place long, external_id string, mode string, of_player string, of_act long"

    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted = _wanted(filters, {"of_player": str, "of_act": int})
        return iter(filters)

    def _split(self, files: list[tuple[Taken, int]]) -> list[Pages]:
        groups: dict[tuple[str, int], list[str]] = {}
        for file, _ in files:
            parts = file.path.rsplit("/", 3)[-3:]
            if len(parts) == 3 and parts[1].isdigit() and parts[2].removesuffix(".json").isdigit():
                player, act = parts[0], int(parts[1])
                if player in self.wanted.get("of_player", {player}) and act in self.wanted.get("of_act", {act}):
                    groups.setdefault((player, act), []).append(file.path)
        return [Pages(player, act, paths) for (player, act), paths in sorted(groups.items())]

    def partitions(self) -> list[Pages]:
        return self._split(Files(self.options["path"]).queue(".json"))

    def read(self, partition: Pages | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where nothing is planned
            return
        files = Files(self.options["path"])
        for path in partition.paths:
            page = int(path.rsplit("/", 1)[1].removesuffix(".json"))
            for place, entry in enumerate(json.loads(files.read(path)).get("data") or []):
                found = (entry.get("attributes") or {}).get("id")
                if found is not None:
                    yield partition.player, partition.act, page, place, str(found), (entry.get("metadata") or {}).get("modeName"), partition.player, partition.act


class Lines(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def split_values(text: str) -> list[str | None]:
    """The values of an INSERT's list, behind its parenthesis: quoted texts without their quotes, NULL as none, all else as it stands."""
    out, at, size = [], 0, len(text)
    while at < size:
        while at < size and text[at] in " ,":
            at += 1
        if at >= size or text[at] == ")":
            break
        if text[at] == "'":
            end = at + 1
            while end < size and (text[end] != "'" or text[end + 1 : end + 2] == "'"):
                end += 2 if text[end] == "'" else 1
            out.append(text[at + 1 : end].replace("''", "'"))
            at = end + 1
        else:
            end = next((i for i in range(at, size) if text[i] in ",)"), size)
            word = text[at:end].strip()
            out.append(None if word.upper() == "NULL" else word)
            at = end
    return out


class InsertReader(DataSourceReader):
    schema_ddl = "table string, columns array<string>, values array<string>, of_table string"

    def __init__(self, options: dict):
        self.options, self.wanted = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted = _wanted(filters, {"of_table": str})
        return iter(filters)

    def _split(self, files: list[tuple[Taken, int]]) -> list[Lines]:
        step = int(self.options.get("splitbytes", SPLIT_BYTES))
        return [Lines(f.path, at, min(at + step, size)) for f, size in files for at in range(0, size, step)]

    def partitions(self) -> list[Lines]:
        return self._split(Files(self.options["path"]).queue(".sql"))

    def read(self, partition: Lines | None) -> Iterator[tuple]:
        """The lines that begin within the partition's bytes; the last one may end beyond them."""
        if partition is None:
            return
        files = Files(self.options["path"])
        begin = max(partition.start - 1, 0)
        data = files.read(partition.path, begin, partition.stop - begin)
        at = 0 if partition.start == 0 else data.find(b"\n") + 1
        if partition.start and not at:
            return
        while not data.endswith(b"\n"):
            more = files.read(partition.path, begin + len(data), 1 << 20)
            if not more:
                break
            cut = more.find(b"\n")
            data += more if cut < 0 else more[: cut + 1]
        for line in data[at:].decode("utf-8", "replace").split("\n"):
            m = INSERT.match(line)
            if m and m[1] in self.wanted.get("of_table", {m[1]}):
                yield m[1], [c.strip() for c in m[2].split(",")] if m[2] else None, split_values(line[m.end() :]), m[1]


class Queue(DataSourceStreamReader):
    """A reader over the files that came since the last offset."""

    def __init__(self, reader: DataSourceReader, suffix: str):
        self.reader, self.suffix = reader, suffix

    def _files(self) -> list[tuple[Taken, int]]:
        return Files(self.reader.options["path"]).queue(self.suffix)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return files[-1][0]._asdict() if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.reader._split([f for f in self._files() if Taken(**start) < f[0] <= Taken(**end)])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.reader.read(partition)


class ArenaPages(DataSource):
    reader_class, suffix = PageReader, ".json"

    @classmethod
    def name(cls) -> str:
        return "arena_pages"

    def schema(self) -> str:
        return self.reader_class.schema_ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reader_class(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Queue(self.reader_class(self.options), self.suffix)


class ArenaInserts(ArenaPages):
    reader_class, suffix = InsertReader, ".sql"

    @classmethod
    def name(cls) -> str:
        return "arena_inserts"


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filters pushed into them."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ArenaPages)
    spark.dataSource.register(ArenaInserts)


def paged_history(spark: SparkSession, path: str, players: list[str] | None = None, acts: list[int] | None = None) -> DataFrame:
    """player, act_id, place (counted over the pages), external_id, mode: what ``ingest.whole_history`` and ``ingest.discover`` take; of ``players`` and ``acts`` alone, if given."""
    register(spark)
    rows = spark.read.format("arena_pages").load(path)
    rows = rows if players is None else rows.where(F.col("of_player").isin(players))
    rows = rows if acts is None else rows.where(F.col("of_act").isin(acts))
    return rows.select("player", "act_id", (F.col("page") * 100_000 + F.col("place")).alias("place"), "external_id", "mode")


def crawled_once(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the documents named by pages as they come, each external_id once, however many pages name it; its state is the ids seen."""
    register(spark)
    return spark.readStream.format("arena_pages").load(path).drop("of_player", "of_act").dropDuplicates(["external_id"])


def insert_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(row: map of column to text) of a dump's INSERTs into ``table`` that name their columns."""
    register(spark)
    rows = spark.read.format("arena_inserts").load(path).where(F.col("of_table") == table)
    return rows.where("columns is not null and size(columns) = size(values)").select(F.map_from_arrays("columns", "values").alias("row"))
