"""What the corpus operators share: the shared folder, staged tables, deterministic samples, splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder

#: Arrow batches hold at most so many bytes, whatever the rows' number: very long texts come in small batches.
BATCH_BYTES = 16 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands Python batches of bounded bytes from now on (unless it sets a bound of its own)."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str((1 << 31) - 1), f"{(1 << 31) - 1}b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tarnwick_folder = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_tarnwick_folder", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go as soon as it has ended; its result must lie in the shared folder by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is bound to it, which the optimiser does not inline."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def hash_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most so many rows: those of the smallest hashes of the keys.

    Rows far above the wanted share are filtered where they lie, so that the task that orders the rest
    reads about most rows however many partitions there are.
    """
    n, place = df.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 52))
    if n > most:
        df = df.filter(place < int(min(1.0, (1.3 * most + 300) / n) * (1 << 52)))
    return df.orderBy(place, *keys).limit(most)


def sampled_labels(labels: DataFrame, column: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """At most per_class rows (doc_id, y, w) of either label, by the order of a hash of doc_id; w: the rows of the label that each stands for.

    Rows with a null id or label give nothing; several labels of one id count as their rounded mean;
    ids in the held-out remainder are left out.  The result has a fixed bound, so it may be broadcast.
    """
    ids = (
        labels.select("doc_id", F.col(column).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    )
    sizes = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [hash_sample(ids.filter(F.col("y") == y), per_class, "doc_id").withColumn("w", F.lit(max(1.0, sizes.get(y, 0) / per_class))) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
