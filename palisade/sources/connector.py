"""Reading sources, materializing models, and small fetches: a thin layer over the session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from palisade.operators import anomaly
from palisade.sources.storage import TableStore


class ConnectorError(RuntimeError):
    """A source, strategy or query that can't be served."""


class SparkConnector:
    """Relations are temporary views; tables are versioned Parquet folders with a view over the newest version."""

    def __init__(self, spark: SparkSession, target: Path | str) -> None:
        """``target`` is a path or URI of storage that all executors share; tables go to its folder ``data``."""
        self.spark, self.target = spark, str(target)
        self.tables = TableStore(spark, f"{self.target}/data")

    engine_name = "spark"

    def register_source(self, name: str, path: str, schema: str | None = None) -> DataFrame:
        """A CSV (with header) or Parquet file as a view. CSV types are inferred unless a schema is given."""
        if path.endswith(".parquet"):
            df = self.spark.read.parquet(path)
        elif schema is not None:
            df = self.spark.read.csv(path, header=True, schema=schema)
        else:
            df = self.spark.read.csv(path, header=True, inferSchema=True)
        df.createOrReplaceTempView(name)
        return df

    def path_exists(self, path: str) -> bool:
        """Whether a file or folder is there, on whatever file system its path names."""
        if "://" not in path and not path.startswith("file:"):
            return Path(path).exists()
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def materialize(self, name: str, df: DataFrame, kind: str, protected: bool = False) -> DataFrame:
        """View and ephemeral stay lazy; table and incremental are written. A protected relation that exists is kept."""
        if kind not in ("view", "table", "ephemeral", "incremental"):
            raise ConnectorError(f"unknown materialization {kind!r}")
        if kind in ("view", "ephemeral"):
            if not (protected and kind == "view" and self.exists(name)):
                df.createOrReplaceTempView(name)
            return self.spark.table(name)
        if not (protected and self.tables.current(name)):
            self.tables.publish(name, self.tables.stage(name, df))
        return self.open(name)

    def open(self, name: str) -> DataFrame:
        """The newest version of a table, under its name."""
        written = self.tables.read(name)
        written.createOrReplaceTempView(name)
        return written

    def execute(self, sql: str) -> None:
        """Run a statement and discard its rows."""
        self.spark.sql(sql).write.format("noop").mode("overwrite").save()

    def fetch_sample(self, sql: str, rows: int = 500) -> DataFrame:
        return self.spark.sql(sql).limit(rows)

    def fetch_columns(self, name: str) -> list[tuple[str, str, bool]]:
        """Name, type and nullability of each column."""
        if not self.exists(name):
            raise ConnectorError(f"no relation {name!r}")
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.spark.table(name).schema.fields]

    def query_scalar(self, sql: str) -> int:
        """The first cell of a query, a whole number."""
        row = self.spark.sql(sql).first()
        if row is None or row[0] is None:
            raise ConnectorError("the query gave no value")
        return int(row[0])

    def fetch_column_averages(self, name: str, columns: list[str]) -> dict[str, float]:
        return anomaly.averages(self.spark.table(name), columns)
