"""Tables that are derived once in a session and then read by every query that needs them.

A derived table is written as Parquet to the folder that all executors share, so a
lost executor costs no recomputation, and readers push their filters and columns
down to it. It is kept by the input folder that it comes from and the state of that folder's
files, so files that change are derived from anew. Tables keyed by match are
bucketed by it: joins, windows and groupings on the match read them as they lie.

A new application derives its own tables, unless ``spark.roundlens.store`` names a
folder: tables in it are found again by later applications.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STORE = "spark.roundlens.store"
#: By application, folder, state of its files and name: the registered table.
_kept: dict[tuple[str, str, str, str], str] = {}
#: By application, folder and state of its files: the parts that its rows ask for.
_parts: dict[tuple[str, str, str], int] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session of one machine that names none gets a temporary folder, a cluster's must name it."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="roundlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        got = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table of its own."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_state(spark: SparkSession, source: str) -> str:
    """A digest of the paths, sizes and times of a folder's files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    found, files = [], path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def as_it_lies(table: DataFrame) -> DataFrame:
    """``table`` for a join by match: merged bucket by bucket, never broadcast. A broadcast copy is held by every task and grows with the input until Spark's threshold stops it."""
    return table.hint("merge")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def parts_of(spark: SparkSession, source: str, count: Callable[[], int]) -> int:
    """The parts that work on the folder ``source`` is cut into: ``count`` asked once for the files as they are, and no fewer than shuffles have partitions.

    Shuffles of the session begin with as many, which adaptive execution puts together again where they are small.
    """
    key = (spark.sparkContext.applicationId, source, folder_state(spark, source))
    if key not in _parts:
        _parts[key] = count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _parts[key])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def kept(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: str | None = None, n: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The table ``name`` derived from the folder ``source`` as its files are now; built and written when first asked for.

    ``by`` buckets it by that column, into ``n`` buckets or as many as shuffles have partitions, each sorted by ``order``;
    a table that an earlier application left in the store keeps its own number and order.
    """
    state = folder_state(spark, source)
    key = (spark.sparkContext.applicationId, source, state, name)
    if key not in _kept:
        store = spark.conf.get(STORE, None)
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{store.rstrip('/')}/{name}-{state}" if store else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if store and _exists(spark, f"{path}/_SUCCESS") and _exists(spark, f"{path}.layout"):
            columns, buckets, *ordered = spark.read.text(f"{path}.layout", wholetext=True).first()[0].strip().split("\n")
            clustered = f"CLUSTERED BY ({by}) {f'SORTED BY ({ordered[0]})' if ordered else ''} INTO {buckets} BUCKETS" if by else ""
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {clustered} LOCATION '{path}'")
        else:
            n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
            df = build()
            writer = df.repartition(n, by).write.bucketBy(n, by) if by else df.write
            writer = writer.sortBy(*order) if order else writer
            writer.mode("overwrite").format("parquet").option("path", path).saveAsTable(table)
            if store:
                spark.createDataFrame([("\n".join([_ddl(df.schema), str(n), *([", ".join(order)] if order else [])]),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.layout")
        _kept[key] = table
    return spark.table(_kept[key])
