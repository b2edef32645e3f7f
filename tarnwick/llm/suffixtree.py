"""Language-model scores from a probabilistic suffix tree over words.

The root holds the distribution of single words (add-0.1 over the words of all training texts).  A context
of one to DEPTH words is a candidate state if any next word follows it twice; its next words are counted
over all training texts; it is kept if what its distribution gains over its longest kept suffix (the
divergence times its count) outweighs the cost of its parameters.  A kept state discounts its counts and
gives the remaining mass to its suffix's distribution, so every state's distribution sums to 1.  A token is
scored by the longest kept suffix of the words before it.

Every word that training texts hold twice has a number, by falling count, and may stand in contexts and after
them; a word seen once can do neither.  The AT_HAND most frequent words are known to every task, the others get
their numbers by a join with the texts' words.  The tree grows with the corpus: no threshold is a share of the
tokens, and contexts and next words lie in tables.  A context is one long, so more words than 63 bits hold
DEPTH times are an error (2**31 words for two, 2**21 for three).

A document's score is a sum over its grams (runs of up to DEPTH + 1 words): a gram adds what it has over its
suffix, and as a context the logarithm of the mass its state leaves to the suffix.  Texts are read twice,
for their words and for the words' numbers; grams are then counted, and later looked up, one length after
the other: tasks sort what they hold and send it packed to the bucket of the gram's context, and a bucket is
worked off as a stream, so that memory is bounded by BUCKET and a frequent gram is one entry of each flush.
Where documents look grams up, the most frequent ones are answered by a table of fixed size on the spot.

Cases: a null, empty or blank text is one end token; repeated rows are texts of their own; a null doc_id
counts as the empty text for the fold; without training rows every token has the probability of an unknown one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, in_batches, lean_shuffles, remainder, staged
from .tokencount import most_frequent

ADD = 0.1
DEPTH, DISCOUNT = 2, 0.75
#: Nats that a state must gain for itself and for each of its next words.
STATE_COST, NEXT_COST = 10.0, 2.0
#: Numbers 0 and 1 are a word without a number and a text's end.
END, FIRST = 1, 2
#: Words whose numbers every task knows; those of the others are joined.
AT_HAND = 1 << 19
#: A limit of the words that contexts are made of, for a smaller tree; None: all.
VOCABULARY = None
#: Grams of a length that are answered on the spot, in a table of so many places.
MOST_FREQUENT, PLACES = 300_000, 1 << 20
#: Tokens that a task works on at once, grams that it holds before it sends them, and grams of a bucket, about.
SLICE, FLUSH, BUCKET = 1 << 19, 2_000_000, 1_500_000
#: The buckets of a length are worked off in so many rounds, one after the other.
ROUNDS = 1

#: A row of packed grams on its way to a bucket: flag 0 for the tree's own ones (value: value), 1 for grams to look up, 2 for answers.
PACKED = {"bucket": pa.int32(), "flag": pa.int32(), "first": pa.int64(), "context": pa.binary(), "word": pa.binary(), "text": pa.binary(), "value": pa.binary()}
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_KINDS[v]}" for k, v in columns.items())


def _rows(columns: dict[str, pa.DataType], values: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(columns.values())], names=list(columns))


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0: the number of bytes that the largest takes, then the lowest bytes of all, the next ones, and so on."""
    n = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n]).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    n = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view("<i8").ravel()


def _hashed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = context.astype(np.uint64) * np.uint64(0x9E3779B185EBCA87) ^ word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(29))


def _bucket_of(context: np.ndarray, buckets: int) -> np.ndarray:
    """Grams of one context lie in one bucket."""
    return ((_hashed(context, np.zeros(1, np.int64)) >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def _sums(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each gram once, with the sum of its n, in the order of the grams' hashes."""
    if not len(n):
        return context, word, n
    code = _hashed(context, word)
    order = np.argsort(code)
    context, word, n = context[order], word[order], n[order]
    begins = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    return context[begins], word[begins], np.add.reduceat(n, begins)


def _added(at: np.ndarray, values: np.ndarray, n: int = 0) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(float)  # of nothing it is whole numbers


def _by_bucket(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts by bucket, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    arrays, numbers = [a[order] for a in arrays], np.bincount(bucket)
    ends = np.cumsum(numbers)
    for b in np.flatnonzero(numbers):
        yield int(b), [a[ends[b] - numbers[b] : ends[b]] for a in arrays]


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts, A-Z in lower case: the number of each word's text, its place in the list of distinct words, and that list."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    of, words = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), lists.flatten().dictionary_encode()
    codes, full = words.indices.to_numpy(), pc.binary_length(words.dictionary).to_numpy() > 0
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    return of[keep], codes[keep].astype(np.int64), words.dictionary


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur in a batch; the empty word stands for the texts' ends."""
    for batch in batches:
        _, codes, words = words_in(batch.column(0))
        n = np.bincount(codes, minlength=len(words))
        some = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.filter(some).cast(pa.string()), pa.array([""])]), pa.array(np.append(n[n > 0], batch.num_rows), pa.int64())], ["word", "n"])


def _column(seq: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts' numbers of words, four bytes each."""
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(seq.astype("<u4"))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of words, where texts begin and the last ends) of a column of texts."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u4").astype(np.int64), (offsets - offsets[0]) // 4


def grams(ids: pa.Array, length: int, bits: int, others: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, word) of all runs of so many tokens that contexts can be made of, each word of a context so many bits; the last may be an end, or (others) any other word."""
    seq, begins = _numbers(ids)
    sizes = np.diff(begins)
    ok = np.arange(len(seq)) - np.repeat(begins[:-1], sizes) >= length - 1
    if not others:
        ok &= seq > 0
    context = np.zeros(len(seq), np.int64)
    for back in range(length - 1, 0, -1):
        before = np.zeros(len(seq), np.int64)
        before[back:] = seq[:-back]
        ok &= before >= FIRST
        context = context << bits | before
    return np.repeat(np.arange(len(sizes)), sizes)[ok], context[ok], seq[ok]


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many texts that they have about so many tokens."""
    for batch in batches:
        _, begins = _numbers(batch.column("ids"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _coded(context: np.ndarray, word: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams as one number each, in their order, and which of them have a number: none of whose words takes more than its share of 63 bits."""
    share, code, most = 63 // length, word.copy(), word.copy()
    if bits <= share:
        return context << bits | word, np.ones(len(word), bool)
    for k in range(length - 1):
        part = context >> bits * k & (1 << bits) - 1
        code |= part << share * (k + 1)
        most |= part
    return code, most >> share == 0


def _decoded(code: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    share = min(bits, 63 // length)
    context = np.zeros(len(code), np.int64)
    for k in range(length - 1):
        context |= (code >> share * (k + 1) & (1 << share) - 1) << bits * k
    return context, code & (1 << share) - 1


def _counted(length: int, bits: int, buckets: int, turn: int):
    """Grams of the texts, summed in each flush and packed by bucket; of every ROUNDS-th bucket.  Most are one number, which is sorted by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, found, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            code = np.concatenate(codes)
            code.sort()
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            n, code = np.diff(np.append(begins, len(code))), code[begins]
            context, word, times = _sums(*(np.concatenate([f[i] for f in found]) for i in range(3)))
            order = np.argsort(context)
            codes.clear()
            found.clear()
            for arrays in ([*_decoded(code, length, bits), n], [context[order], word[order], times[order]]):
                for b, (c, w, m) in _by_bucket(_bucket_of(arrays[0], buckets), arrays):
                    yield _rows(PACKED, [[b, 0, 0, packed(np.diff(c, prepend=0)), packed(w), None, packed(m)]])

        for batch in _slices(batches, SLICE):
            _, context, word = grams(batch.column("ids"), length, bits, others=True)
            mine = _bucket_of(context, buckets) % ROUNDS == turn
            context, word = context[mine], word[mine]
            code, fits = _coded(context, word, length, bits)
            codes.append(code[fits])
            found.append((context[~fits], word[~fits], np.ones(len(word) - int(fits.sum()), np.int64)))
            held += len(word)
            if held > FLUSH:
                yield from out()
                held = 0
        if held:
            yield from out()

    return run


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(k)[i].as_py() for k in PACKED}


GRAMS = {"context": pa.int64(), "word": pa.int64(), "n": pa.int64(), "size": pa.int64()}
#: best: log10 of the word's probability after the context; value: what a gram adds to a score; a state's rows stand under the gram that the context is.
WEIGHED = {"context": pa.int64(), "word": pa.int64(), "n": pa.int64(), "best": pa.float64(), "value": pa.float64(), "state": pa.bool_()}


def _records(columns: dict[str, pa.DataType], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(arrays[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000], t) for a, t in zip(arrays, columns.values(), strict=True)], names=list(columns))


def weighed(context: np.ndarray, word: np.ndarray, n: np.ndarray, size: np.ndarray, below: np.ndarray, bits: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Which contexts become states, and what their next words add; rows are ordered by context and hold all next words seen twice.

    below: log10 of the word's probability by the context's longest kept suffix.
    """
    if not len(n):
        return
    begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    m, sizes = np.diff(np.append(begins, len(n))), size[begins]
    s, own, other, mass = (np.add.reduceat(v, begins) for v in (n, n * np.log10(n - DISCOUNT), n * below, 10.0**below))
    back = np.log10(np.maximum(1 - (s - DISCOUNT * m) / sizes, 1e-12) / np.maximum(1 - mass, 1e-12))
    gain = own - s * np.log10(sizes) - other + np.maximum(sizes - s, 0) * back
    kept = gain * math.log(10) > STATE_COST + NEXT_COST * m
    of = np.repeat(np.arange(len(begins)), m)
    p, hit = np.log10((n - DISCOUNT) / size), kept[of]
    best, value = np.where(hit, p, below), np.where(hit, p - below - back[of], 0.0)
    use = hit if last else np.ones(len(n), bool)  # the longest grams are no suffixes
    yield from _records(WEIGHED, [a[use] for a in (context, word, n, best, value, np.zeros(len(n), bool))])
    key = context[begins][kept]
    yield from _records(WEIGHED, [key >> bits, key & (1 << bits) - 1, sizes[kept], np.zeros(len(key)), back[kept], np.ones(len(key), bool)])


def _merged(most: int, bits: int, root=None, last: bool = False):
    """The grams of each bucket that occur twice or more, with the context's count (with root: weighed); rows come ordered by bucket, and so many grams are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, held = None, [], 0

        def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _sums(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

        def out() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            arrays = together()
            order = np.argsort(arrays[0])
            context, word, n = (a[order] for a in arrays)
            begins = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.repeat(np.add.reduceat(n, begins), np.diff(np.append(begins, len(n))))
            keep = (n >= 2) & (word > 0)
            arrays = [a[keep] for a in (context, word, n, size)]
            if root is None:
                yield from _records(GRAMS, arrays)
            else:
                yield from weighed(*arrays, root.value[1](arrays[1]), bits, last)

        for row in _in_buckets(batches):
            if row["bucket"] != bucket:
                yield from out()
                bucket, parts, held = row["bucket"], [], 0
            parts.append((np.cumsum(unpacked(row["context"])), unpacked(row["word"]), unpacked(row["value"])))
            held += len(parts[-1][0])
            if held > most:
                parts = [together()]
                held = len(parts[0][0]) // 2  # so that a bucket of many different grams is not summed again and again
        yield from out()

    return run


def _weighing(bits: int, last: bool):
    """Rows ordered by context, which have their below, weighed; a context may go on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.float64 if c == "below" else np.int64) for c in (*GRAMS, "below")]
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, (*GRAMS, "below"), strict=True)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from weighed(*(h[:whole] for h in held), bits, last)
            held = [h[whole:] for h in held]
        yield from weighed(*held, bits, last)

    return run


class Root:
    """log10 of words' probabilities by number: the words' at hand as a list; the others' numbers follow by falling count, those of a count from where it begins."""

    def __init__(self, near: np.ndarray, begins: np.ndarray, far: np.ndarray):
        self.near, self.begins, self.far = near, begins, far

    def __call__(self, number: np.ndarray) -> np.ndarray:
        away = number >= len(self.near)
        out = self.near[np.where(away, 0, number)]
        if away.any():
            out[away] = self.far[np.searchsorted(self.begins, number[away], side="right") - 1]
        return out


class Model:
    """total, distinct: training tokens; bits: of a word's number; back: log10 of the mass that a word's state leaves, by number, for the words at hand; tables: (context, word, n, value) by length, a gram's values as next word and as context in rows of their own (of a single word not at hand: word 0)."""

    def __init__(self, total: int, distinct: int, bits: int, back: np.ndarray, words: DataFrame, tables: dict[int, DataFrame]):
        self.total, self.distinct, self.bits, self.back, self.words, self.tables = total, distinct, bits, back, words, tables

    def buckets(self) -> int:
        return max(int(self.words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.total // BUCKET))


def _ranked(words: DataFrame, begin: int) -> DataFrame:
    """(word, n, number): words by falling count, numbered from begin on without gaps."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its partition
    ranked = staged(words.orderBy(F.desc("n"), "word").select("word", "n", F.spark_partition_id().alias("part"), place.alias("place")), "ranked")
    begins = []
    for r in sorted(ranked.groupBy("part").agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        begins.append((r.part, begin))
        begin += r.n
    begins = words.sparkSession.createDataFrame(begins, "part int, begin long")
    return ranked.join(F.broadcast(begins), "part").select("word", "n", (F.col("begin") + F.col("place")).alias("number"))


def _numbered(docs: DataFrame, total: int, shared, train, more: bool) -> DataFrame:
    """(doc_id, row, train, n_tokens, known, base, ids, tail, places): the texts as numbers of words; known and base without the words not at hand, which lie in tail.

    places: (with more) for each number 0 of ids the word's place in tail.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root = shared.value
        for batch in batches:
            of, codes, words = words_in(batch.column("text"))
            texts, width = batch.num_rows, max(1, len(words))
            number = pc.index_in(words, value_set=known).fill_null(-FIRST).to_numpy().astype(np.int64) + FIRST
            ids = number[codes] if len(codes) else codes
            sizes = np.bincount(of, minlength=texts) + 1
            ends = np.cumsum(sizes)
            seq, word = np.full(ends[-1], END, np.int64), np.ones(ends[-1], bool)
            word[ends - 1] = False
            seq[word] = ids
            owner = np.repeat(np.arange(texts), sizes)
            have = seq > 0 if total else np.zeros(len(seq), bool)
            n_known, base = np.bincount(owner[have], minlength=texts), _added(owner[have], root.near[seq[have]], texts)
            key, at, times = np.unique(of[ids == 0] * width + codes[ids == 0], return_inverse=True, return_counts=True)
            tails = np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=texts))]).astype(np.int32)
            tail = pa.StructArray.from_arrays([words.take(pa.array(key % width)).cast(pa.string()), pa.array(times, pa.int32())], ["w", "n"])
            away = of[ids == 0] if more else of[:0]
            begins = np.concatenate([[0], np.cumsum(np.bincount(away, minlength=texts))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(begins), pa.array(at[: len(away)] - tails[away], pa.int32()))
            columns = [*(batch.column(c) for c in ("doc_id", "row", "train")), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), _column(seq, ends), pa.ListArray.from_arrays(pa.array(tails), tail), places]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "train", "n_tokens", "known", "base", "ids", "tail", "places"])

    rows = in_batches(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"), train.alias("train"))
    return rows.mapInArrow(run, f"doc_id {kind}, row long, train boolean, n_tokens long, known long, base double, ids binary, tail array<struct<w:string,n:int>>, places array<int>")


def _tails(rows: DataFrame, table: DataFrame, more: bool) -> DataFrame:
    """(__row, rest_known, rest_base) of the words in tail, by table(word, log, number); with more also numbers: array of struct(at, number), at a place in tail."""
    long = rows.select("row", F.posexplode("tail").alias("at", "t")).select("row", "at", "t.w", "t.n")
    joined = long.join(table.hint("shuffle_hash"), F.col("w") == F.col("word"), "left")
    known, base = F.sum(F.when(F.col("word").isNotNull(), F.col("n")).otherwise(0)), F.sum(F.coalesce("log", F.lit(0.0)) * F.col("n"))
    numbers = [F.collect_list(F.when(F.col("number").isNotNull(), F.struct("at", "number"))).alias("numbers")] if more else []
    return joined.groupBy("row").agg(known.alias("rest_known"), base.alias("rest_base"), *numbers).withColumnRenamed("row", "__row")


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose ids have the numbers of the words in tail too."""
    for batch in batches:
        seq, begins = _numbers(batch.column("ids"))
        texts, zeros = np.arange(batch.num_rows), np.flatnonzero(seq == 0)
        of, own = (np.repeat(texts, pc.list_value_length(batch.column(c)).fill_null(0).to_numpy()) for c in ("places", "numbers"))
        place, found = batch.column("places").flatten().to_numpy().astype(np.int64), batch.column("numbers").flatten()
        at, number = (pc.struct_field(found, c).to_numpy().astype(np.int64) for c in ("at", "number"))
        if len(number):
            width = max(int(place.max()), int(at.max())) + 1
            order = np.argsort(own * width + at)
            key, number = (own * width + at)[order], number[order]
            want = of * width + place
            to = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[to] == want
            seq[zeros[hit]] = number[to[hit]]
        columns = [batch.column(c) for c in ("doc_id", "row", "train", "n_tokens", "known", "base")]
        yield pa.RecordBatch.from_arrays([*columns, _column(seq, begins[1:])], ["doc_id", "row", "train", "n_tokens", "known", "base", "ids"])


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "flag")


def learnt(docs: DataFrame, train, depth: int = DEPTH) -> tuple[Model, DataFrame, DataFrame]:
    """The tree of the rows for which train holds, all rows as numbers, and what their words not at hand add to known and base."""
    spark = docs.sparkSession
    words = in_batches(docs).filter(train).select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(words, "words")
    r = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = r.n or 0, r.v
    limit = math.inf if VOCABULARY is None else VOCABULARY
    top = most_frequent(words.filter("word != ''"), "n", min(AT_HAND, limit)).toArrow()
    top = top.take(pc.sort_indices(top, [("n", "descending"), ("word", "ascending")]))
    vocabulary = top["word"].combine_chunks().cast(pa.large_string()) if top.num_rows else pa.array([], pa.large_string())
    counts = np.concatenate([[0, (words.filter("word = ''").agg(F.sum("n")).first()[0] or 0)], top["n"].to_numpy().astype(float)])
    others = words.filter("word != ''")
    if top.num_rows:  # which holds all words of its counts
        others = others.filter(F.col("n") < int(top["n"][-1].as_py()))
    # a word seen once is in no gram seen twice; the counts of the others differ in few values, as the words of a count are many
    steps = sorted(((r.n, r.v) for r in others.filter("n >= 2").groupBy("n").agg(F.count("*").alias("v")).collect()), reverse=True) if len(counts) - FIRST < limit else []
    begins = len(counts) + np.cumsum([0, *(v for _, v in steps)])
    log = lambda n: np.log10((n + ADD) / (total + ADD * (distinct + 1)))
    root = Root(log(counts), begins[:-1], log(np.array([n for n, _ in steps], float)))
    numbers = min(int(begins[-1]), FIRST + limit)
    bits = max(1, (numbers - 1).bit_length())
    if bits > min(31, 63 // depth):
        raise ValueError(f"{numbers} words are too many for contexts of {depth} words")
    shared = spark.sparkContext.broadcast((vocabulary, root))
    rows = staged(_numbered(docs, total, shared, train, bool(steps)), "numbers")
    table = others.withColumn("number", F.lit(None).cast("long"))
    if steps:
        table = _ranked(others.filter("n >= 2"), len(counts)).withColumn("number", F.when(F.col("number") < numbers, F.col("number"))).unionByName(table.filter("n = 1"))
    probability = F.log10((F.col("n") + ADD) / (total + ADD * (distinct + 1)))
    rest = staged(_tails(rows, table.select("word", probability.alias("log"), "number"), bool(steps)), "tails")
    if steps:
        first, rows = rows, staged(rows.drop("tail").join(rest.select("__row", "numbers"), F.col("row") == F.col("__row"), "left").mapInArrow(_resolved, rows.drop("tail", "places").schema), "numbers")
        dropped(first)
    model = Model(total, distinct, bits, np.zeros(len(counts)), words, {})
    if not total:
        return model, rows, rest
    parts, trains, buckets = {k: [] for k in range(1, depth + 2)}, rows.filter("train").select("ids"), model.buckets()
    suffixes = None
    for length in range(2, depth + 2):
        last, out = length == depth + 1, []
        for turn in range(ROUNDS):
            dealt = _dealt(trains.mapInArrow(_counted(length, bits, buckets, turn), _ddl(PACKED)), buckets)
            if length == 2:  # the suffix of a word is the root
                out.append(staged(dealt.mapInArrow(_merged(BUCKET, bits, shared, last), _ddl(WEIGHED)), "weighed"))
                continue
            found = staged(dealt.mapInArrow(_merged(BUCKET, bits), _ddl(GRAMS)), "grams")
            suffix = F.col("context").bitwiseAND((1 << bits * (length - 2)) - 1) * (1 << bits) + F.col("word")
            # a gram seen twice has a suffix seen twice, so none is lost
            joined = found.withColumn("key", suffix).join(suffixes.hint("merge"), "key").select(*GRAMS, "below")
            out.append(staged(joined.repartition(buckets, "context").sortWithinPartitions("context").mapInArrow(_weighing(bits, last), _ddl(WEIGHED)), "weighed"))
            dropped(found)
        whole = reduce(DataFrame.unionByName, out)
        suffixes = whole.filter("not state").select((F.col("context") * (1 << bits) + F.col("word")).alias("key"), F.col("best").alias("below"))
        columns = ("context", "word", "n", "value")
        parts[length].append(whole.filter("not state and value != 0").select(*columns))
        parts[length - 1].append(whole.filter("state").select(*columns))
    single = parts.pop(1)[0]
    for r in single.filter(F.col("word") < len(counts)).select("word", "value").toLocalIterator():  # a row for each of the words at hand at most
        model.back[r.word] = r.value
    if steps:
        parts[2].append(single.filter(F.col("word") >= len(counts)).select(F.col("word").alias("context"), F.lit(0).cast("long").alias("word"), "n", "value"))
    for length, tables in parts.items():
        model.tables[length] = reduce(DataFrame.unionByName, tables)
    return model, rows, rest


class Places:
    """The most frequent grams of a length, each at the place of its hash; of several with one place the most frequent."""

    def __init__(self, top: pa.Table):
        top = top.take(pc.sort_indices(top, [("n", "ascending"), ("context", "ascending"), ("word", "ascending")]))
        context, word = (top[c].to_numpy().astype(np.int64) for c in ("context", "word"))
        self.context, self.word, self.value = np.full(PLACES, -1, np.int64), np.full(PLACES, -1, np.int32), np.zeros(PLACES)
        at = self.at(context, word)
        self.context[at], self.word[at], self.value[at] = context, word, top["value"].to_numpy()

    def at(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (_hashed(context, word) % np.uint64(len(self.context))).astype(np.int64)


def _asked(length: int, bits: int, buckets: int, turn: int, places, back: np.ndarray):
    """For each slice of texts the sums of what is answered on the spot, and the other grams by bucket; of every ROUNDS-th bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in _slices(batches, SLICE):
            row = batch.column("row").to_numpy()
            of, context, word = grams(batch.column("ids"), length, bits)
            lone = np.zeros(batch.num_rows)
            if length == 2:  # states of one word
                one, _, single = grams(batch.column("ids"), 1, bits)
                near = single < len(back)
                lone += _added(one[near], back[single[near]], batch.num_rows)
                if not near.all():
                    of, context, word = (np.concatenate(a) for a in ((of, one[~near]), (context, single[~near]), (word, np.zeros(len(near) - int(near.sum()), np.int64))))
            mine = _bucket_of(context, buckets)
            keep = mine % ROUNDS == turn
            of, context, word, mine = of[keep], context[keep], word[keep], mine[keep]
            at = known.at(context, word)
            hit = (known.context[at] == context) & (known.word[at] == word)
            sums = _added(of[hit], known.value[at[hit]], batch.num_rows)
            if turn == 0:
                sums += lone
            first, far = int(row.min()), ~hit  # the slice's name
            out = [[b, 1, first, packed(c), packed(w), packed(t), None] for b, (c, w, t) in _by_bucket(mine[far], [context[far], word[far], of[far]])]
            out.append([first % buckets, 2, first, packed(row - first), None, packed(np.arange(len(row))), sums.tobytes()])
            yield _rows(PACKED, out)

    return run


def _tabled(buckets: int):
    """The tree's grams of a length, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            context, word, value = (np.concatenate([f[i] for f in found]) for i in range(3))
            found.clear()
            for b, (c, w, v) in _by_bucket(_bucket_of(context, buckets), [context, word, value]):
                yield _rows(PACKED, [[b, 0, 0, packed(c), packed(w), None, v.tobytes()]])

        for batch in batches:
            found.append([batch.column(c).to_numpy().astype(t) for c, t in (("context", np.int64), ("word", np.int64), ("value", float))])
            held += batch.num_rows
            if held > FLUSH:
                yield from out()
                held = 0
        if held:
            yield from out()

    return run


#: rows: only where a slice's texts are named, by their row less the first.
ANSWERS = {"first": pa.int64(), "rows": pa.binary(), "text": pa.binary(), "value": pa.binary()}


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the tree has for the grams of each bucket, summed by text; in a bucket the tree's own grams come first."""
    bucket, own, table = None, [], None
    for row in _in_buckets(batches):
        if row["bucket"] != bucket:
            bucket, own, table = row["bucket"], [], None
        if row["flag"] == 0:
            own.append((unpacked(row["context"]), unpacked(row["word"]), np.frombuffer(row["value"])))
        elif row["flag"] == 2:
            yield _rows(ANSWERS, [[row["first"], row["context"], row["text"], row["value"]]])
        elif own:
            if table is None:
                context, word, value = (np.concatenate([o[i] for o in own]) for i in range(3))
                context, word, value = _sums(context, word, value)
                table = _hashed(context, word), context, word, value
            context, word, text = (unpacked(row[c]) for c in ("context", "word", "text"))
            at = np.minimum(np.searchsorted(table[0], _hashed(context, word)), len(table[0]) - 1)
            hit = (table[1][at] == context) & (table[2][at] == word)
            sums = _added(text[hit], table[3][at[hit]])
            some = np.flatnonzero(sums)
            if len(some):
                yield _rows(ANSWERS, [[row["first"], None, packed(some), sums[some].tobytes()]])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, value): the answers of each slice of texts, summed; they come ordered by slice."""
    first, sums, names = None, np.zeros(0), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(sums)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(names[some] + first, pa.int64()), pa.array(sums[some])], ["__row", "value"])

    for batch in batches:
        for i in range(batch.num_rows):
            at, rows, text, value = (batch.column(c)[i].as_py() for c in ANSWERS)
            if at != first:
                yield from out()
                first, sums = at, np.zeros(0)
            names = names if rows is None else unpacked(rows)
            text, value = unpacked(text), np.frombuffer(value)
            if len(text) and text.max() >= len(sums):
                sums = np.concatenate([sums, np.zeros(int(text.max()) + 1 - len(sums))])
            np.add.at(sums, text, value)
    yield from out()


def gains(model: Model, rows: DataFrame) -> DataFrame | None:
    """(__row, value): for each row of numbers the log10 that its tokens have over the root's probabilities."""
    out, buckets, spark = [], model.buckets(), rows.sparkSession
    asking = rows.select("row", "ids")
    for length, table in model.tables.items():
        top = most_frequent(table, "n", MOST_FREQUENT).groupBy("context", "word").agg(F.max("n").alias("n"), F.sum("value").alias("value"))
        places = spark.sparkContext.broadcast(Places(top.toArrow()))
        own = table.select("context", "word", "value").mapInArrow(_tabled(buckets), _ddl(PACKED))
        for turn in range(ROUNDS):
            asked = asking.mapInArrow(_asked(length, model.bits, buckets, turn, places, model.back), _ddl(PACKED))
            answers = staged(_dealt(own.unionByName(asked), buckets).mapInArrow(_answered, _ddl(ANSWERS)), "answers")
            out.append(staged(answers.repartition("first").sortWithinPartitions("first").mapInArrow(_totals, "__row long, value double"), "gains"))
            dropped(answers)
    return reduce(DataFrame.unionByName, out).groupBy("__row").agg(F.sum("value").alias("value")) if out else None


def scored(docs: DataFrame, modulus: int = 10, held: int = 0, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs; learnt outside the held-out remainder."""
    fold = remainder(F.col("doc_id"), modulus)
    with lean_shuffles(docs.sparkSession):
        model, rows, rest = learnt(docs, fold != held, depth)
        more = gains(model, rows)
        out = rows.select("doc_id", "row", "train", "n_tokens", "known", "base").join(rest, F.col("row") == F.col("__row"), "left").drop("__row")
        if more is not None:
            out = out.join(staged(more, "gains"), F.col("row") == F.col("__row"), "left")
    known = F.col("known") + F.coalesce("rest_known", F.lit(0))
    base = F.col("base") + F.coalesce("rest_base", F.lit(0.0)) + (F.col("n_tokens") - known) * math.log10(ADD / (model.total + ADD * (model.distinct + 1)))
    value = F.coalesce("value", F.lit(0.0)) if more is not None else F.lit(0.0)
    return out.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + value).alias("score")
    )
