"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is its weight's share of all words, at most three times its own words; the excess is
shared again by weight.  Every document of a source then has the same expected number of copies: the whole
part is taken at once, the fraction is a probability.  Probabilities are rounded in pairs: as much mass
(probability times size) as fits moves from one document to the other, in a random direction that keeps
both expectations, until one of them is 0 or 1; the other goes on to the next pair.  Pairs are folded in
buckets of bounded size; the one residual of each bucket joins those of other buckets at the next level of
a tree, so that a source of any size is rounded in parallel and its sum of words is kept but for one document.

Randomness is a hash of the ids and a seed: reruns agree.  Cases: a null source is a source, the last; a
null or empty text has size 0 and is not taken; repeated rows are documents of their own; a null doc_id is
an id like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged

CYCLE, MOST_COPIES, BUCKET = 3, 3, 48
WORDS = r"[^ \t\n\x0B\f\r]+"


def ranked(df: DataFrame, name: str, order: list[Column], at: str) -> DataFrame:
    """df with its 0-based place in a total order, numbered in parallel: ranges of keys, then offsets of the ranges."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = staged(parts, name)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select(F.col("__part").alias("__p"), "__n").withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__i", inside).join(offsets.select("__p", "__offset"), F.col("__part") == F.col("__p")).withColumn(at, F.col("__i") + F.col("__offset")).select(*df.columns, at)


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """sizes(source, source_size, weight) with target: weights share the whole, each source stops at most times its size."""
    cap = F.col("source_size") * float(most)
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, done = 0.0, False
    while not done:
        full = cap < F.col("weight") * level
        r = sizes.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("free"), F.count_if(full).alias("n")).first()
        new = (total - r.capped) / r.free if r.free else level
        done, level = new <= level, max(new, level)
    return sizes.withColumn("target", F.least(cap, F.col("weight") * level))


def _pivot(acc: Column, x: Column, level: int, seed: int) -> Column:
    """One step of a bucket's fold: acc.rest holds at most one undecided document, acc.done the decided ones."""
    row = lambda r, p: F.struct(r["h"].alias("h"), r["doc_id"].alias("doc_id"), r["rn"].alias("rn"), r["size"].alias("size"), p.alias("p"))
    none = F.slice(F.array(row(x, x["p"])), 1, 0)

    def moved(v: Column) -> Column:
        a, b = v["a"], v["b"]
        room_a, mass_a, room_b, mass_b = (1 - a["p"]) * a["size"], a["p"] * a["size"], (1 - b["p"]) * b["size"], b["p"] * b["size"]
        up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
        chance = F.pmod(F.xxhash64(a["h"], b["h"], F.lit(level), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        return let(
            F.struct(a.alias("a"), b.alias("b"), (chance * (up + down) < down).alias("to_a"), up.alias("up"), down.alias("down"), room_a.alias("ra"), mass_a.alias("ma"), room_b.alias("rb"), mass_b.alias("mb")),
            settled,
        )

    def settled(v: Column) -> Column:
        a, b, to_a = v["a"], v["b"], v["to_a"]
        a_ends = F.when(to_a, v["ra"] <= v["mb"]).otherwise(v["ma"] <= v["rb"])
        b_ends = F.when(to_a, v["mb"] <= v["ra"]).otherwise(v["rb"] <= v["ma"])
        pa = F.when(a_ends, F.when(to_a, 1.0).otherwise(0.0)).otherwise(F.when(to_a, a["p"] + v["up"] / a["size"]).otherwise(a["p"] - v["down"] / a["size"]))
        pb = F.when(b_ends, F.when(to_a, 0.0).otherwise(1.0)).otherwise(F.when(to_a, b["p"] - v["up"] / b["size"]).otherwise(b["p"] + v["down"] / b["size"]))
        ra, rb = F.array(row(a, pa)), F.array(row(b, pb))
        rest = F.when(a_ends & b_ends, none).when(a_ends, rb).otherwise(ra)
        done = F.when(a_ends & b_ends, F.concat(ra, rb)).when(a_ends, ra).otherwise(rb)
        return F.struct(rest.alias("rest"), F.concat(acc["done"], done).alias("done"))

    return F.when(F.size(acc["rest"]) == 0, F.struct(F.array(row(x, x["p"])).alias("rest"), acc["done"].alias("done"))).otherwise(
        let(F.struct(F.element_at(acc["rest"], 1).alias("a"), x.alias("b")), moved)
    )


def _step(level: int, seed: int) -> Callable[[Column, Column], Column]:
    return lambda acc, x: _pivot(acc, x, level, seed)


def rounded(fractions: DataFrame, seed: int = 1) -> DataFrame:
    """fractions(source_rank, doc_id, rn, size > 0, 0 < p < 1) -> (source_rank, doc_id, rn, size, up): up is 0 or 1 with mean p."""
    live = fractions.withColumn("h", F.xxhash64("doc_id", "rn", "size", "source_rank", F.lit(seed)))
    counts = live.groupBy("source_rank").agg(F.count("*").alias("__n"))
    live = staged(live.join(counts.withColumnRenamed("source_rank", "__s"), F.col("source_rank") == F.col("__s")).drop("__s"), "fractions")
    most = live.agg(F.max("__n")).first()[0] or 0
    decided, level = [], 0
    kind = live.schema["doc_id"].dataType.simpleString()
    empty = f"array<struct<h:bigint,doc_id:{kind},rn:int,size:double,p:double>>"
    while True:
        buckets = F.ceil(F.col("__n") / BUCKET).cast("long")
        grouped = live.withColumn("__b", F.pmod(F.xxhash64("h", F.lit(level)), buckets)).groupBy("source_rank", "__b").agg(
            F.sort_array(F.collect_list(F.struct("h", "doc_id", "rn", F.col("size").cast("double").alias("size"), "p"))).alias("rows"), F.max(buckets).alias("__n")
        )
        zero = F.struct(F.array().cast(empty).alias("rest"), F.array().cast(empty).alias("done"))
        folded = F.aggregate("rows", zero, _step(level, seed))
        out = staged(grouped.select("source_rank", "__n", folded.alias("f")), f"level-{level}")
        pick = lambda what: out.select("source_rank", "__n", F.explode(f"f.{what}").alias("r")).select("source_rank", "__n", "r.*")
        decided.append(pick("done").select("source_rank", "doc_id", "rn", F.col("size").cast("long").alias("size"), F.col("p").cast("int").alias("up")))
        live, most, level = pick("rest"), -(-most // BUCKET), level + 1
        if most <= 1:
            last = F.pmod(F.xxhash64("h", F.lit(seed), F.lit("last")), F.lit(1 << 52)) / float(1 << 52) < F.col("p")
            decided.append(live.select("source_rank", "doc_id", "rn", F.col("size").cast("long").alias("size"), last.cast("int").alias("up")))
            break
    whole = decided[0]
    for d in decided[1:]:
        whole = whole.unionByName(d)
    return whole


def planned(docs: DataFrame, cycle: int = CYCLE, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, rn, same, copies), a row for each row of docs.

    rn numbers, and same counts, the rows that agree in doc_id, source and size.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))
    rows = staged(rows.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("same")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).alias("source_size"))
    sizes = ranked(sizes, "sources", [F.col("source").asc_nulls_last()], "source_rank")
    sizes = staged(targets(sizes.withColumn("weight", (F.col("source_rank") % cycle + 1).cast("double")), most), "targets")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(each + 1e-9)
    plan = sizes.select(F.col("source").alias("__source"), "source_rank", "source_size", "target", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), each - whole).alias("p"))
    rows = rows.withColumn("rn", F.explode(F.sequence(F.lit(1), "same"))).join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = staged(rows, "planned")
    ups = rounded(rows.filter("size > 0 and p > 1e-9").select("source_rank", "doc_id", "rn", "size", "p"), seed)
    ups = ups.toDF("__r", "__d", "__n", "__z", "__up")
    on = (F.col("source_rank") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rn") == F.col("__n")) & (F.col("size") == F.col("__z"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce("__up", F.lit(0)))
    return rows.join(ups, on, "left").select("doc_id", "source", "size", "source_size", "target", "rn", "same", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    return planned(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say, with the columns of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    plan = planned(docs).filter("copies > 0 or same > 1").select("doc_id", "source", "size", "rn", "same", "copies")
    plan = staged(plan.toDF("__d", "__s", "__z", "__k", "__same", "__c"), "plan")
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (size == F.col("__z"))
    once = docs.join(plan.filter("__same = 1").hint("merge"), on)  # alike at every size
    out = once.withColumn("__i", F.explode(F.sequence(F.lit(1), "__c"))).select(docs.columns)
    if plan.filter("__same > 1").limit(1).count():
        same = docs.join(plan.filter("__same > 1 and __k = 1"), on, "left_semi").withColumn("__size", size)
        order = Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64(*docs.columns))
        same = same.withColumn("__rn", F.row_number().over(order)).join(plan.filter("__same > 1 and __c > 0"), on & (F.col("__rn") == F.col("__k")))
        out = out.unionByName(same.withColumn("__i", F.explode(F.sequence(F.lit(1), "__c"))).select(docs.columns))
    return out
