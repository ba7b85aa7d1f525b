"""Tables on storage that all executors share: immutable versions, and a pointer that says which one counts.

A version is a folder of Parquet files under the table's own folder. Publishing writes a small pointer file aside and
renames it without overwriting, so readers see the old version or the new one, never none, and of two writers one is told.
Frames over an older version stay readable until it is the third oldest.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer published first."""


class TableStore:
    """Tables under one root, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _pointers(self, name: str) -> list[tuple[int, str]]:
        """Versions and their folders, oldest first."""
        folder = self._path(f"{self.root}/{name}/_versions")
        if not self._fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(f.partition(".")[0][1:]), f.partition(".")[2]) for f in found if f.startswith("v"))

    def current(self, name: str) -> str | None:
        """The folder of the table's newest version; None where there is no table."""
        found = self._pointers(name)
        return f"{self.root}/{name}/{found[-1][1]}" if found else None

    def read(self, name: str) -> DataFrame:
        path = self.current(name)
        if path is None:
            raise FileNotFoundError(f"no table {name!r} under {self.root}")
        return self.spark.read.parquet(path)

    def stage(self, name: str, df: DataFrame) -> str:
        """Write a version that nobody sees yet; returns its folder."""
        path = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def discard(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def publish(self, name: str, path: str, keep: int = 2) -> int:
        """Make a staged version the table's newest, and delete those older than the newest ``keep``.

        The version's number and folder are in the pointer's name, so the rename alone publishes it.
        """
        known = self._pointers(name)
        number, folder = (known[-1][0] if known else 0) + 1, path.rpartition("/")[2]
        versions = f"{self.root}/{name}/_versions"
        self._fs.mkdirs(self._path(versions))
        claim = self._path(f"{versions}/.claim-{number:010d}")
        if not self._fs.createNewFile(claim):
            raise ConflictError(f"version {number} of {name} is being published")
        aside = self._path(f"{versions}/.{uuid.uuid4().hex}")
        self._fs.create(aside, False).close()
        if not self._fs.rename(aside, self._path(f"{versions}/v{number:010d}.{folder}")):
            raise ConflictError(f"version {number} of {name} could not be published")
        for old, gone in known[: max(0, len(known) + 1 - keep)]:
            self._fs.delete(self._path(f"{versions}/v{old:010d}.{gone}"), False)
            self._fs.delete(self._path(f"{versions}/.claim-{old:010d}"), False)
            self.discard(f"{self.root}/{name}/{gone}")
        return number


_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all executors reach, under the one that ``spark.checkpoint.dir`` names; it goes when the driver ends.

    Where the setting is absent, a temporary folder serves local sessions; a cluster without it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = tempfile.mkdtemp(prefix="palisade_")
            atexit.register(shutil.rmtree, _SCRATCH[app], ignore_errors=True)
        base = f"file://{_SCRATCH[app]}"
    return f"{base.rstrip('/')}/palisade/{uuid.uuid4().hex}"
