"""An ordered key-value table: a DataFrame (key BINARY, value BINARY) with half-open range scans and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyValue:
    """Each batch of changes becomes a Parquet folder of (key, value, deleted, version); the newest version of a key counts."""

    SCHEMA = "key binary, value binary, deleted boolean, version long"

    def __init__(self, spark: SparkSession, folder: str):
        from .storage import Storage

        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Storage(spark)

    def version(self) -> int:
        return max((int(n[1:]) for n in self.files.names(self.folder) if n[:1] == "v" and n[1:].isdigit()), default=0)

    def apply(self, puts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """One atomic batch: puts(key, value), deletes(key).  Gives the new version."""
        v, parts = self.version() + 1, []
        if puts is not None:
            parts.append(puts.select("key", "value", F.lit(False).alias("deleted"), F.lit(v).cast("long").alias("version")))
        if deletes is not None:
            parts.append(deletes.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted"), F.lit(v).cast("long").alias("version")))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        whole.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), F.col("deleted")).alias("c"), F.max("version").alias("version")).select("key", "c.value", "c.deleted", "version").write.parquet(f"{self.folder}/v{v}")
        return v

    def snapshot(self, as_of: int | None = None) -> DataFrame:
        """(key, value) as of a version."""
        last = self.version() if as_of is None else as_of
        paths = [f"{self.folder}/v{k}" for k in range(1, last + 1) if self.files.exists(f"{self.folder}/v{k}")]
        if not paths:
            return self.spark.createDataFrame([], "key binary, value binary")
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths)
        newest = rows.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("c"))
        return newest.filter("NOT c.deleted").select("key", "c.value")

    def get(self, key: bytes, as_of: int | None = None) -> bytes | None:
        row = self.snapshot(as_of).filter(F.col("key") == F.lit(bytearray(key))).first()
        return None if row is None else bytes(row.value)

    def scan(self, start: bytes | None = None, end: bytes | None = None, as_of: int | None = None) -> DataFrame:
        """Keys from start up to, and without, end, in byte order."""
        df = self.snapshot(as_of)
        df = df if start is None else df.filter(F.col("key") >= F.lit(bytearray(start)))
        df = df if end is None else df.filter(F.col("key") < F.lit(bytearray(end)))
        return df.orderBy("key")
