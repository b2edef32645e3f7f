"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, doc_id, a number of the row).  A sample weighted by size gives
splitters that cut this order into many ranges of about equal bytes, as many as the rows need; ranges that
come out overfull are sampled again and subdivided.  Splitters and ranges' totals are a few hundred bytes for
each 250,000 rows.  Exact bytes and rows of each range, and running sums inside the ranges, then
place every record, so that the shards differ by about one record and each is a contiguous range.  Equal
texts lie side by side: a group whose bytes are under SNAP of a shard stays in one shard (splitters fall
inside a key only if its sample stands for twice that), a larger one is cut only where a shard ends; copies
of any number thus spread over as many ranges as their bytes need.

Cases: a null text has size 8 and the CRC of the empty text; a null doc_id sorts first; repeated rows are
records of their own (the row's number parts them); fewer records than shards leave shards empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Ranges for each shard at least, and rows for each range at most, about; sample rows for each range.
RANGES, ROWS, OVERSAMPLE = 24, 250_000, 8
#: Splitters that stand in the plan at most; the others are a table of some bytes for each 250,000 rows, which is broadcast.
COARSE = 1024
#: A range this many times the mean is overfull and subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 4.0, 4
#: A group of equal texts below this part of a shard stays whole.
SNAP = 0.01
_FIRST = -(2**62)
Splitter = tuple[int, int, int]


def _at_or_below(cuts: Column, n: Column, most: int) -> Column:
    """How many of the n splitters in an array, most at most, are at or below (key, id, row), by binary search."""
    here = F.struct("key", "id", "row")
    powers = [1 << k for k in range(most.bit_length() - 1, -1, -1)] or [1]
    step = lambda at, by: F.when((at + by <= n) & (F.get(cuts, F.least(at + by, n) - 1) <= here), at + by).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), step)


def _ranged(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """rows with the number of their range: first among every so-manieth splitter, which the plan holds, then among those between, which are joined."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    each = max(64, -(-len(splitters) // COARSE))
    groups = [splitters[at : at + each] for at in range(0, len(splitters), each)]
    coarse = F.expr("array(" + ",".join("struct({}L,{}L,{}L)".format(*g[0]) for g in groups) + ")")
    parts = [(0, 0, [])] + [(k + 1, k * each + 1, g[1:]) for k, g in enumerate(groups)]
    parts = rows.sparkSession.createDataFrame(parts, "__c int, __base int, __cuts array<struct<k:bigint,d:bigint,r:bigint>>")
    found = rows.withColumn("__c", _at_or_below(coarse, F.lit(len(groups)), len(groups))).join(F.broadcast(parts), "__c")
    return found.withColumn("range", F.col("__base") + _at_or_below(F.col("__cuts"), F.size("__cuts"), each)).drop("__c", "__base", "__cuts")


def _sample(rows: DataFrame, each: float, seed: int) -> list[Splitter]:
    """Rows kept with probability size / each, by a hash; sorted."""
    chance = F.pmod(F.xxhash64("key", "id", "row", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return sorted((r.key, r.id, r.row) for r in rows.filter(chance < F.col("size") / each).select("key", "id", "row").collect())


def _cuts(sample: list[Splitter], every: int, each: float, whole: float) -> list[Splitter]:
    """Every so-manieth sample row; the cut is before all rows of its key unless the key's sample rows stand for more than whole bytes."""
    times: dict[int, int] = {}
    for k, _, _ in sample:
        times[k] = times.get(k, 0) + 1
    return sorted({(k, d, r) if times[k] * each > whole else (k, _FIRST, _FIRST) for k, d, r in sample[every // 2 :: every]})


def sharded(docs: DataFrame, shards: int = 24, seed: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(F.xxhash64(text), 1).alias("key"),
        F.greatest(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)), F.lit(_FIRST)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows, "records")
    spark, all_ = docs.sparkSession, rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total = all_.bytes or 0
    ranges = max(shards * RANGES, -(-all_.n // ROWS))
    each, whole = max(1.0, total / (ranges * OVERSAMPLE)), 2 * SNAP * total / shards
    splitters = _cuts(_sample(rows, each, seed), OVERSAMPLE, each, whole)
    for again in range(ROUNDS + 1):
        placed = _ranged(rows, splitters)
        stats = {r["range"]: r for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        full = [k for k, r in stats.items() if r.bytes > OVERFULL * total / ranges and r.n > 1]
        if not full or again == ROUNDS:
            break
        finer = max(1.0, each / 2 ** (again + 1))
        overfull = placed.join(F.broadcast(spark.createDataFrame([(k,) for k in full], "range int")), "range", "left_semi")
        more = sorted(set(splitters) | set(_cuts(_sample(overfull, finer, seed + again + 1), OVERSAMPLE, finer, whole)))
        if len(more) == len(splitters):
            break
        splitters = more
    before, b, n = [], 0, 0
    for k in sorted(stats):
        before.append((k, b, n))
        b, n = b + stats[k].bytes, n + stats[k].n
    placed = placed.join(F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long")), "range")
    inside = Window.partitionBy("range").orderBy("key", "id", "row")
    group = Window.partitionBy("range", "key")
    placed = placed.withColumn("before", F.sum("size").over(inside) - F.col("size")).withColumn("i", F.row_number().over(inside))
    placed = placed.withColumn("group_size", F.sum("size").over(group)).withColumn("group_before", F.min("before").over(group))
    middle = F.when(F.col("group_size") <= SNAP * total / shards, F.col("group_before") + F.col("group_size") / 2).otherwise(F.col("before") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + middle) * shards / float(max(total, 1)))).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("i") - 1).alias("place"))
    placed = staged(placed, "placed")
    counts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(k, 0) for k in range(s)) for s in range(shards)]
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
