"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every W consecutive k-gram hashes the smallest is kept, for documents and items alike, so that any
shared span of W + k - 1 words shares a kept hash.  Documents that share a kept hash with any item are
candidates; in these every window is compared, words and all, with the windows of the items, and the words
that the found windows cover are the hits.  Hashes only find candidates; hits are exact.  Work follows the
number of positions: a window that repeats, in a document or in items, is one row on the items' side.

Cases: a null or empty text has no words; an item shorter than the span is one window and is found by the
hash of its whole length, at every place of the documents; repeated rows come back each; rows that share a
doc_id are told apart by their text; items that share an id count as one; a null item_id is not listed but
its words hit; an empty benchmark hits nothing; extra columns of any name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

SPAN, GRAM = 10, 5
#: A side of a join is broadcast only if its rows, at the bytes a row that are stated there, take at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes of a kept hash, and of a document's id and text hash, in a broadcast table.
MARK_BYTES, ID_BYTES = 32, 48
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of letters, digits and whatever is beyond ASCII.  The other characters are listed one by one: ranges make a slow class.
_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def _cased_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def exact_words(text: Column) -> Column:
    return _cased_words(F.translate(text, _UPPER, _LOWER))


def _word_hashes(text: Column) -> Column:
    """Hashes of the words, each lower-cased by itself: a function of the exact word, so equal wherever those are, and cheaper to make."""
    return F.transform(_cased_words(text), lambda w: F.xxhash64(F.lower(w)))


def _positions(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, length: int) -> Column:
    """The hash of each run of so many words, by position."""
    return F.transform(_positions(F.size(words), length), lambda i: F.xxhash64(F.lit(length), *[F.get(words, i + j) for j in range(length)]))


def winnowed(grams: Column, window: int) -> Column:
    """The smallest of every so many consecutive hashes, distinct."""
    return F.array_distinct(F.transform(_positions(F.size(grams), window), lambda i: F.least(*[F.get(grams, i + j) for j in range(window)])))


def _marks(text: Column, short: list[int], span: int, gram: int) -> Column:
    """Kept hashes of a text; the words and their k-grams are each computed once."""
    kept = lambda w: [let(_grams(w, gram), lambda g: winnowed(g, span - gram + 1)), *[_grams(w, n) for n in short]]
    return let(_word_hashes(text), lambda w: F.array_distinct(F.concat(*kept(w))) if short else kept(w)[0])


def _windows(words: Column, lengths: list[int], own: Column | None = None) -> Column:
    """(at, len, win) for the runs of so many words, by position; own: the one length that is meant, if not all are."""
    at = lambda n: F.transform(_positions(F.size(words), n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("win")))
    none = F.slice(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit("").alias("win"))), 1, 0)
    return F.concat(none, *[at(n) if own is None else F.when(own == n, at(n)).otherwise(none) for n in lengths])


def _sized(df: DataFrame, bytes_a_row: float) -> DataFrame:
    """df for a join: broadcast if it is small enough, else merged with the other side."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df.hint("merge")


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_hit, items): for the documents in which any window of an item occurs."""
    items = staged(items.select("item_id", "text").filter(F.size(_cased_words(F.col("text"))) > 0).distinct(), "items")
    sizes = items.select(F.size(_cased_words(F.col("text"))).alias("n"), F.octet_length("text").alias("b")).agg(F.array_sort(F.collect_set(F.when(F.col("n") < span, F.col("n")))).alias("short"), F.max("n").alias("n")).first()
    short = list(sizes.short or [])
    lengths = [*short, *([span] if (sizes.n or 0) >= span else [])]
    size = F.size("w")
    own = F.when(size >= span, let(_grams(F.col("w"), gram), lambda g: winnowed(g, span - gram + 1)))
    for n in short:
        own = own.when(size == n, _grams(F.col("w"), n))
    item_marks = staged(items.select(_word_hashes(F.col("text")).alias("w")).select(F.explode(own).alias("mark")).distinct(), "item-marks")
    marks = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    marks = marks.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_marks(F.col("text"), short, span, gram)).alias("mark"))
    found = staged(marks.join(_sized(item_marks, MARK_BYTES), "mark", "left_semi").select("doc_id", "text_hash").distinct(), "candidates")
    cand = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    ids = found.toDF("__d", "__h")
    cand = cand.join(_sized(ids, ID_BYTES), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    # a window of an item, and the items that hold it
    words, whole = F.col("words"), F.least(F.size("words"), F.lit(span))
    of = items.select(F.col("item_id").cast("string").alias("item"), exact_words(F.col("text")).alias("words"))
    of = staged(of.select("item", F.explode(_windows(words, lengths, whole)).alias("x")).select("item", "x.win").distinct(), "item-windows")
    known = of.select("win").distinct()
    mean = known.agg(F.avg(F.octet_length("win")).alias("b")).first().b or 0.0
    mine = cand.select("doc_id", "text_hash", exact_words(F.col("text")).alias("words")).select("doc_id", "text_hash", F.explode(_windows(words, lengths)).alias("x")).select("doc_id", "text_hash", "x.*")
    mine = staged(mine.join(_sized(known, mean + MARK_BYTES), "win", "left_semi"), "hit-windows")
    spans = mine.select("doc_id", "text_hash", F.struct(F.col("at").alias("from"), (F.col("at") + F.col("len")).alias("to")).alias("span"))
    covered = F.aggregate(
        F.sort_array(F.collect_set("span")),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["to"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["to"] - F.greatest(acc["end"], x["from"]))).alias("sum")),
        lambda acc: acc["sum"],
    )
    n_hit = spans.groupBy("doc_id", "text_hash").agg(covered.cast("long").alias("n_hit"))
    listed = mine.select("doc_id", "text_hash", "win").distinct().join(of, "win").select("doc_id", "text_hash", "item").distinct()
    listed = listed.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return n_hit.join(listed, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))).select("doc_id", "text_hash", "n_hit", "items")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    found = staged(hits(docs, items), "hits").withColumnsRenamed({"doc_id": "__d", "text_hash": "__h"})
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    out = all_docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no window of an item occurs."""
    found = staged(hits(docs, items).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")), "hits")
    return docs.join(_sized(found, ID_BYTES), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_anti")
