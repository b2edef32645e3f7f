"""Token counts of whole texts, exactly as a public tokenizer file gives them, without making ids of the texts.

A BPE tokenizer with a pre-tokenizer merges inside pre-tokens only, so a text's count is the sum over its
pre-tokens.  Pre-tokens never span white space: texts are cut there in whole Arrow batches, every distinct
piece is cut into pre-tokens once, and every distinct pre-token is encoded once.  A document's frequencies
of its pieces are joined to the pieces' counts and summed: the most frequent pieces' counts go to the
executors as a dictionary of bounded size, all others are joined.

Cases: a null or empty text has 0 bytes and 0 tokens; the special tokens' strings count as one token where
the library's default takes them so; repeated rows and repeated or null ids are rows of their own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, staged

#: The dictionary on every executor holds at most so many of the most frequent pre-tokens.
MOST_FREQUENT = 300_000
OVER = 2048
#: White space as the tokenizers' regular expressions know it (Python's has four control characters more).
_SPACE = r"\t-\r \x85\xa0  -     　"


class PreTokens:
    """The part of a tokenizer file (normalizer, pre-tokenizer, special tokens) that parts a text into pre-tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "Sequence" or spec.get("truncation") or spec.get("padding"):
            raise ValueError("only BPE files with a Split and a ByteLevel pre-tokenizer are supported")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("unsupported pre-tokenizer")
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"}:
            raise ValueError("unsupported normalizer")
        self.path, self.pattern = path, split["pattern"]["Regex"].replace(r"\s", _SPACE)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or len(t["content"].split()) != 1 for t in spec["added_tokens"]):
            raise ValueError("unsupported special token")
        self.special = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("path", "pattern", "special")}

    def prepare(self) -> PreTokens:
        self._find, self._special = regex.compile(self.pattern).findall, regex.compile(self.special)
        return self

    def of_piece(self, piece: str) -> tuple[int, list[str]]:
        """Special tokens and pre-tokens of a piece between ASCII white space; neither spans that."""
        found, out = self._special.findall(piece) if self.special else (), []
        for part in self._special.split(piece) if found else (piece,):
            low = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final sigma
            out += self._find("".join(map(str.lower, low)) if "İ" in low else low.lower())
        return len(found), out

    def encoder(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """For each piece between ASCII white space the number of its text, and the pieces; an empty piece stands at white space at an end."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    begins = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(texts)), np.diff(begins)), lists.flatten().dictionary_encode()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pieces of each batch, and how often they occur."""
    for batch in batches:
        _, pieces = pieces_of(batch.column(0))
        freq = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))
        yield pa.RecordBatch.from_arrays([pieces.dictionary.cast(pa.string()), pa.array(freq, pa.int64())], ["piece", "freq"])


def _pretokens(pre: PreTokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre.prepare()
        for batch in batches:
            special, parts = [], []
            for piece in batch.column("piece").to_pylist():
                n, ps = pre.of_piece(piece)
                special.append(n)
                parts.append(ps)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("freq"), pa.array(special, pa.int32()), pa.array(parts, pa.list_(pa.string()))], ["piece", "freq", "special", "parts"])

    return run


def _sizes(pre: PreTokens):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pre.encoder()
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = [len(e.ids) for at in range(0, len(words), 1000) for e in t.encode_batch_fast(words[at : at + 1000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], ["p", "n"])

    return run


def distinct_pieces(docs: DataFrame, pre: PreTokens) -> DataFrame:
    """(piece, freq, n): every distinct piece of the texts between white space, how often it occurs, and its number of tokens.

    No pre-token spans white space, so a piece is cut into pre-tokens by itself; each distinct pre-token is encoded once.
    """
    found = in_batches(docs).select("text").mapInArrow(_frequencies, "piece string, freq long").filter("piece != ''").groupBy("piece").agg(F.sum("freq").alias("freq"))
    found = staged(found.mapInArrow(_pretokens(pre), "piece string, freq long, special int, parts array<string>"), "pieces")
    sizes = found.select(F.explode("parts").alias("p")).distinct().mapInArrow(_sizes(pre), "p string, n int")
    # most pieces are one pre-token, and rare: neither side has a frequent key
    each = found.select("piece", F.explode("parts").alias("p")).join(sizes.withColumnRenamed("p", "__p"), F.col("p") == F.col("__p")).groupBy("piece").agg(F.sum("n").cast("int").alias("n"))
    return found.select("piece", "freq", "special").join(each.withColumnRenamed("piece", "__piece"), F.col("piece") == F.col("__piece"), "left").select("piece", "freq", (F.col("special") + F.coalesce("n", F.lit(0))).alias("n"))


def tail_sums(rows: DataFrame, table: DataFrame, key: str, **values) -> DataFrame:
    """rows(row, tail: array of struct(w, n)) joined to table on w = key: per row the sums of the given columns times n.

    w is compared exactly; the table is unique in key and not frequent in the rows (frequent ones are in the dictionary).
    """
    long = rows.select("row", F.explode("tail").alias("t")).select("row", "t.w", "t.n")
    joined = long.join(table.hint("shuffle_hash"), F.col("w") == F.col(key), "left")
    return joined.groupBy("row").agg(*[F.sum(v * F.col("n")).alias(k) for k, v in values.items()]).withColumnRenamed("row", "__row")


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, at most so many: a histogram of the counts' logarithms gives the least count that is taken."""
    size = F.floor(F.log2(count) * 8)
    least, held = None, 0
    for r in sorted(table.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        held += r.n
        if held > most:
            break
        least = r.b
    return table.filter(F.lit(False) if least is None else size >= least)


def counted(docs: DataFrame, path: str, most: int = MOST_FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    pre = PreTokens(path)
    sizes = staged(distinct_pieces(docs, pre), "piece-sizes")
    top = most_frequent(sizes, "freq", most).select("piece", "n").toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast((pa.array(top["piece"], pa.large_string()), top["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_of = frequent.value
        for batch in batches:
            text_of, pieces = pieces_of(batch.column("text"))
            codes, words, texts = pieces.indices.to_numpy().astype(np.int64), pieces.dictionary, batch.num_rows
            at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
            n = np.where(at >= 0, n_of[at], 0) if len(n_of) else np.zeros(len(words), np.int64)
            rare = (at < 0) & (pc.binary_length(words).to_numpy() > 0)
            total = np.bincount(text_of, weights=n[codes], minlength=texts).astype(np.int64)
            far = rare[codes]
            key, times = np.unique(text_of[far] * max(1, len(words)) + codes[far], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, len(words)), minlength=texts))]).astype(np.int32)
            tail = pa.StructArray.from_arrays([words.take(pa.array(key % max(1, len(words)))).cast(pa.string()), pa.array(times, pa.int32())], ["w", "n"])
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), size, pa.array(total), pa.ListArray.from_arrays(pa.array(ends), tail)], ["doc_id", "row", "n_bytes", "total", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = in_batches(docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.mapInArrow(run, f"doc_id {kind}, row long, n_bytes long, total long, tail array<struct<w:string,n:int>>"), "frequencies")
    rest = tail_sums(rows, sizes.select("piece", F.col("n").alias("pieces")), "piece", rest=F.col("pieces").cast("long"))
    n = F.col("total") + F.coalesce("rest", F.lit(0))
    return rows.join(rest, F.col("row") == F.col("__row"), "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > OVER).alias("over_limit"))
