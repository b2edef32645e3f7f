"""SimHash near-duplicates: fingerprints of word shingles, linked exactly by sharded vantage-point trees.

Equal fingerprints fold into one before any search.  The upper tree is grown on a bounded sample of the
distinct fingerprints; every fingerprint goes to its own shard and to those whose boundary it overlaps; in
a shard a deeper tree finds all pairs within the radius and gives back a spanning forest of them, never the
pairs of a dense group.  Components come from distributed contraction.

Cases: null, empty and blank texts have fingerprint zero, linked like any other; fewer words than a shingle
make one shingle; repeated rows come back each; a null doc_id never names a component unless all its
documents lack one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vptree
from .common import dropped, hash_sample, in_batches, staged
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: About so many distinct fingerprints are wanted in a shard; the upper tree has so many leaves at most, beyond which
#: shards grow; it is grown on a sample of so many fingerprints for each leaf, between these bounds.
SHARD, MOST_SHARDS, EACH, SAMPLE = 600, 1 << 16, 32, (1 << 14, 1 << 19)
#: Fingerprints that a task routes at once.
ROUTED = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if it is in over half the shingles' XXH64."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    begins = [0, *ends[:-1]]
    pieces = map(whole.__getitem__, map(slice, begins, (e - 1 for e in ends[shingle - 1 :])))
    h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), dtype=np.uint64, count=len(words) - shingle + 1)
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_in += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a forest that spans all links of the distinct fingerprints in column fp."""
    count = distinct.count()
    leaves = max(1, min(MOST_SHARDS, -(-count // SHARD)))
    wanted = min(SAMPLE[1], max(SAMPLE[0], EACH * leaves))
    sample = hash_sample(distinct.select("fp"), wanted, "fp").toArrow()["fp"].to_numpy() if leaves > 1 else np.zeros(0, np.int64)
    tree = vptree.Tree(sample.astype(np.int64).view(np.uint64), leaves, radius)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pd.DataFrame]:
            for leaf, members in tree.route(np.concatenate(held).view(np.uint64)):
                yield pd.DataFrame({"leaf": np.full(len(members), leaf, np.int32), "fp": members.view(np.int64)})
            held.clear()

        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64))
            if sum(map(len, held)) >= ROUTED:
                yield from out()
        if held:
            yield from out()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = vptree.links(pdf["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # a shard is small but takes seconds: tasks are made by the number of shards, not by their bytes
    placed = distinct.select("fp").mapInPandas(route, "leaf int, fp long").repartition(-(-leaves // 8), "leaf")
    return placed.groupBy("leaf").applyInPandas(search, "a long, b long")


def grouped(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id, root) for the distinct fingerprints of fps(doc_id, fp)."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    links = staged(near_links(distinct, radius), "links")
    roots = components(links, "a", "b")
    dropped(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("moved"))
    rooted = staged(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.max("moved").alias("many")).filter("many").select(F.col("root").alias("r"), "component_id")
    least = staged(least, "least")  # combined before it is dealt; the join below is then a plain one, whose hot roots are split
    return rooted.join(least, F.col("root") == F.col("r"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of docs."""
    fps = staged(in_batches(docs).select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "documents-fp")
    ids = grouped(fps, radius)
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, one per component: that of the smallest doc_id.

    Where that id repeats inside a component, or no document of the component has an id, the row whose
    content has the smallest hash stays.
    """
    fps = staged(in_batches(docs).select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "documents-fp")
    ids = staged(grouped(fps, radius), "components")
    keep = ids.select(F.col("component_id").alias("doc_id")).distinct()
    odd = staged(fps.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "odd-ids")
    # sorted and merged at every size: a join that is broadcast while it is small would only grow a shuffle later
    kept = docs.join(keep.filter("doc_id is not null").hint("merge"), "doc_id", "left_semi")
    if not odd.limit(1).count():
        return kept
    again = docs.join(odd.withColumnRenamed("doc_id", "__odd"), F.col("doc_id").eqNullSafe(F.col("__odd")), "left_semi")
    again = again.select(F.struct(*docs.columns).alias("__row"), fingerprints(F.col("text"), shingle).alias("fp")).join(ids, "fp").filter(F.col("__row.doc_id").eqNullSafe(F.col("component_id")))
    content = F.xxhash64(*[F.col("__row")[c] for c in docs.columns])
    one = again.groupBy("root").agg(F.min_by("__row", content).alias("r")).select("r.*")
    return kept.join(odd, "doc_id", "left_anti").select(docs.columns).unionByName(one)
