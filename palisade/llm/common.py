"""What the operators of this subpackage share: the shared folder, written tables, shipping of code to workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves local sessions (tests); a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='palisade_')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_MADE: set[str] = set()


@atexit.register
def _clear() -> None:
    """Delete what this driver left in the shared folder."""
    for path in _MADE:
        fs, name = local_path(path)
        with contextlib.suppress(OSError):
            fs.delete_dir(name)


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/palisade/{name}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there: the lineage ends at the files. ``options`` are the writer's.

    Spark deletes the shuffle files of the plan as the write ends; without that they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._palisade_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._palisade_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.discard(table._palisade_path)


#: Bytes of a written table (compressed) up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_small(table: DataFrame) -> DataFrame:
    """``table``, written by ``materialize``, to be broadcast if its files are small, and to be sorted and merged otherwise."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._palisade_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return table.hint("broadcast" if size <= BROADCAST_BYTES else "merge")


def local_path(path: str) -> tuple[object, str]:
    """A pyarrow filesystem and the path within it, for reads and writes by Python tasks."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they import it by name and keep its caches."""
    context = spark.sparkContext
    if getattr(context, "_palisade_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="palisade_ship_")) / "palisade_ship.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted((root / "palisade").rglob("*.py")):
            out.write(file, os.path.relpath(file, root))
    context.addPyFile(str(target))
    context._palisade_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly work on every row: where its files make fewer splits than there are cores, the rows are dealt out.

    A large table has splits enough and is left as it is; a file of one row group can't be split by the scan.
    """
    spark = df.sparkSession
    wanted, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= wanted:
        return df
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df if expected >= wanted * split else df.repartition(wanted)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
