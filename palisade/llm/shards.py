"""A sharded dataset with size-tiered compaction and versioned manifests.

Arrivals are appended as small immutable shards. Compaction merges runs of shards of similar size into files of up to
the target size; each merge is one task that streams its inputs into one output, so nothing is shuffled. Readers see
what a manifest lists. A manifest is a small file of its own version, put in place by one rename that fails if the version
exists, so of two writers one has to try again on top of the other's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from palisade.llm import common

TARGET_BYTES = 128 << 20

#: Rows of an arriving shard: some MB of documents, well below what compaction leaves alone.
ARRIVAL_ROWS = 2000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Shard:
    """One immutable file: its name, size, rows, and how many merges lie behind it."""

    name: str
    bytes: int
    rows: int
    level: int = 0


def plan(shards: Sequence[Shard], target_bytes: int = TARGET_BYTES, low: float = 0.5, high: float = 1.5, least: int = 4) -> list[list[Shard]]:
    """The merges that the sizes call for.

    Shards below the target fall into tiers: a tier takes sizes between ``low`` and ``high`` times its mean, smallest
    first. In a tier of at least ``least`` shards, neighbours in order of arrival are packed into merges of up to the
    target. Equal sizes keep their order of arrival; a merge has at least two shards.
    """
    place = {s.name: i for i, s in enumerate(shards)}
    tiers: list[list[Shard]] = []
    mean = 0.0
    for shard in sorted((s for s in shards if s.bytes < target_bytes * low), key=lambda s: (s.bytes, place[s.name])):
        if tiers and low * mean <= shard.bytes <= high * mean:
            tiers[-1].append(shard)
            mean += (shard.bytes - mean) / len(tiers[-1])
        else:
            tiers.append([shard])
            mean = float(shard.bytes)
    merges = []
    for tier in tiers:
        if len(tier) < least:
            continue
        run: list[Shard] = []
        for shard in sorted(tier, key=lambda s: place[s.name]):
            if run and sum(s.bytes for s in run) + shard.bytes > target_bytes:
                merges.append(run)
                run = []
            run.append(shard)
        merges.append(run)
    return [m for m in merges if len(m) > 1]


#: Bytes in memory that a merge gathers into one row group.
GROUP_BYTES = 32 << 20


def _merger(folder: str, schema: pa.Schema):
    def shaped(piece: pa.RecordBatch) -> pa.Table:
        """A piece of a shard in the dataset's columns: those that it lacks are null, times are in microseconds."""
        have = set(piece.schema.names)
        return pa.table([piece.column(f.name).cast(f.type, safe=False) if f.name in have else pa.nulls(piece.num_rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.local_path(folder)
        for batch in batches:
            for merge, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"{uuid.uuid4().hex}.parquet"
                rows, held, size = 0, [], 0
                with fs.open_output_stream(f"{root}/{name}") as sink:
                    with pq.ParquetWriter(sink, schema, compression="zstd", coerce_timestamps="us", allow_truncated_timestamps=True) as writer:
                        for part in names:
                            with fs.open_input_file(f"{root}/{part}") as source:
                                for piece in pq.ParquetFile(source, coerce_int96_timestamp_unit="us").iter_batches(512):
                                    held.append(shaped(piece))
                                    size += held[-1].nbytes
                                    rows += piece.num_rows
                                    if size >= GROUP_BYTES:
                                        writer.write_table(pa.concat_tables(held))
                                        held, size = [], 0
                        if held:
                            writer.write_table(pa.concat_tables(held))
                    size = sink.tell()
                yield pa.RecordBatch.from_arrays([pa.array([merge], pa.int32()), pa.array([name]), pa.array([size], pa.int64()), pa.array([rows], pa.int64())], names=["merge", "name", "bytes", "rows"])

    return run


def merged_schema(known: str | None, new: StructType) -> StructType:
    """The columns of a dataset (JSON, or None) and of an arrival: new ones come last; one of another type is an error."""
    fields = {} if known is None else {f.name: f for f in StructType.fromJson(json.loads(known))}
    for f in new:
        if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the dataset and {f.dataType.simpleString()} in the arrival")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


class ShardStore:
    """A dataset in ``root``: ``data/`` with shards, ``manifests/`` with one file a version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.data = f"{self.root}/data"
        common.ship(spark)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in (self.data, f"{self.root}/manifests"):
            self._fs.mkdirs(self._path(folder))

    def _read_text(self, path: object) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        found = self._fs.listStatus(self._path(f"{self.root}/manifests"))
        return max([0, *(int(s.getPath().getName()[1:-5]) for s in found if s.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        return json.loads(self._read_text(self._path(f"{self.root}/manifests/v{version:010d}.json")))

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: int, shards: Sequence[Shard], schema: str | None) -> int:
        """Put version ``base`` + 1 in place, or raise ``Conflict`` if it exists.

        The manifest is written aside and renamed without overwriting: all of it appears or nothing.
        """
        text = json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in shards]})
        aside, final = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{base + 1:010d}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, final, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(final):
                raise Conflict(f"version {base + 1} exists") from error
            raise
        return base + 1

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> int:
        """Add ``df`` as small shards, one for each task or for every ``rows_per_shard`` rows. No rows make no shard.

        Columns that the dataset lacks are added to it, and null in its older rows; those that ``df`` lacks are null in the new
        ones. A column of another type than the dataset's is an error, before anything is written.
        """
        merged_schema(self.manifest()["schema"], df.schema)
        folder = uuid.uuid4().hex
        writer = df.write.option("compression", "zstd")
        if rows_per_shard:
            writer = writer.option("maxRecordsPerFile", rows_per_shard)
        writer.parquet(f"{self.data}/{folder}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.data}/{folder}")) if s.getPath().getName().endswith(".parquet")}
        written = self.spark.read.schema(df.schema).parquet(f"{self.data}/{folder}")
        counts = {r["f"]: r["n"] for r in written.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect()}
        new = [Shard(f"{folder}/{name}", sizes[name], n) for name, n in sorted(counts.items())]
        while True:
            now = self.manifest()
            try:
                return self.commit(now["version"], [*self.shards(now["version"]), *new], merged_schema(now["schema"], df.schema).json())
            except Conflict:
                continue

    def compact(self, target_bytes: int = TARGET_BYTES, least: int = 4) -> int:
        """Merge until no tier calls for it. Each round is one job and one commit; a round that loses a race is planned anew."""
        while True:
            now = self.manifest()
            shards = self.shards(now["version"])
            merges = plan(shards, target_bytes, least=least)
            if not merges:
                return now["version"]
            jobs = self.spark.createDataFrame([(i, [s.name for s in m]) for i, m in enumerate(merges)], "merge int, names array<string>")
            schema = to_arrow_schema(StructType.fromJson(json.loads(now["schema"])))
            made = {r["merge"]: r for r in jobs.repartition(len(merges)).mapInArrow(_merger(self.data, schema), "merge int, name string, bytes long, rows long").collect()}
            gone = {s.name: i for i, m in enumerate(merges) for s in m}
            after, placed = [], set()
            for shard in shards:
                i = gone.get(shard.name)
                if i is None:
                    after.append(shard)
                elif i not in placed:
                    placed.add(i)
                    if i in made:
                        after.append(Shard(made[i]["name"], made[i]["bytes"], made[i]["rows"], 1 + max(s.level for s in merges[i])))
            try:
                self.commit(now["version"], after, now["schema"])
            except Conflict:
                continue

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard of each in ``shard``."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing was ever appended")
        schema = StructType.fromJson(json.loads(now["schema"]))
        if not now["shards"]:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(None).cast("string"))
        return self.spark.read.schema(schema).parquet(*[f"{self.data}/{s['name']}" for s in now["shards"]]).withColumn("shard", F.col("_metadata.file_name"))

    def vacuum(self, keep: int = 1, least_age: float = 86_400.0) -> int:
        """Delete the shards that none of the newest ``keep`` versions lists, and older manifests; how many shards went.

        Files younger than ``least_age`` seconds stay: they may belong to a writer that hasn't committed yet.
        """
        newest = self.version()
        versions = [v for v in range(max(1, newest - keep + 1), newest + 1)]
        live = {s.name for v in versions for s in self.shards(v)}
        gone = 0
        listing = self._fs.listFiles(self._path(self.data), True)
        prefix = self._path(self.data).toUri().getPath()
        while listing.hasNext():
            status = listing.next()
            path = status.getPath()
            if path.toUri().getPath()[len(prefix) + 1 :] not in live and status.getModificationTime() <= (time.time() - least_age) * 1000:
                self._fs.delete(path, False)
                gone += path.getName().endswith(".parquet")
        for v in range(1, max(1, newest - keep + 1)):
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        return gone


def compacted(docs: DataFrame, target_bytes: int = TARGET_BYTES, rows_per_shard: int = ARRIVAL_ROWS) -> DataFrame:
    """``docs`` after arriving as small shards and being compacted: its rows as they were, and the ``shard`` of each.

    Shards arrive with ``rows_per_shard`` rows at most, and fewer where a small table would make less than eight of them.
    Rows keep nulls, empty and long texts and repeats; a column named ``shard`` is replaced; an empty table gives no rows.
    """
    named = docs.drop("shard")
    store = ShardStore(docs.sparkSession, common.fresh_path(docs.sparkSession, "shards"))
    store.append(named, max(1, min(rows_per_shard, named.count() // 8)))
    store.compact(target_bytes)
    store.vacuum(least_age=0)
    return store.read()
