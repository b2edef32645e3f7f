"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its words and word
beginnings; the sentences' scores combine by noisy-or into the document's.  Only document labels are
learnt from; the sentence scores that follow locate the offending sentences.

Labelled copies (equal words in equal order, whatever their case) are read once and count as often as they
occur.  Rare features are left to the penalty on weights, which cross-validation over the training rows chooses.

Cases: null and empty texts have no sentences and get the leak probability as score; repeated rows are
scored each; without labelled rows of either class, or where no word is more frequent under label 1, the
score is the smoothed rate of label 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import strings
from .common import in_batches, remainder, sampled_labels

#: At most so many labelled rows of either class are learnt from; each weighs as many rows of its class as it stands for.
SAMPLE_PER_CLASS = 8000
#: At most so many features are kept, by their likelihood ratio.
FEATURES = 4096
#: The least log-likelihood ratio of a feature, below which it is not tried unless there is none above.
LEAST_RATIO = 2.0
#: Penalties on squared weights, of which FOLDS-fold cross-validation chooses.
PENALTIES, FOLDS = (1e-5, 1e-4, 1e-3), 3
PREFIX = 4

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGES = ".,;:!?*#$%&|\"'()[]{}<>-_/\\`~+="


def features(word: str) -> tuple[str, ...]:
    """The word without punctuation at its edges, and its beginning."""
    w = word.strip(_EDGES)
    return () if not w else (w, w[:PREFIX] + "~") if len(w) >= PREFIX else (w,)


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = (Counter(), Counter())
    for pdf in batches:
        for text, y, n in zip(pdf["text"], pdf["y"], pdf["n"], strict=True):
            words = set((text or "").lower().split())
            for f in {f for w in words for f in features(w)}:
                found[y][f] += n
    names = list(found[0].keys() | found[1].keys())
    yield pd.DataFrame({"feature": strings(names), "neg": [found[0][x] for x in names], "pos": [found[1][x] for x in names]})


class Model:
    """weights by feature, bias of a sentence, leak of a document."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak
        self._known: dict[str, tuple[str, ...]] = {}

    def matched(self, word: str) -> tuple[str, ...]:
        """Those of the word's features that have weights; words seen before are looked up."""
        hit = self._known.get(word)
        if hit is None:
            if len(self._known) > 500_000:
                self._known.clear()
            hit = self._known[word] = tuple(f for f in features(word) if f in self.weights)
        return hit

    def instances(self, text: str | None) -> list[tuple[int, int, tuple[str, ...]]]:
        """(begin, end, features) of the sentences that hold any feature."""
        low = (text or "").lower()
        if len(low) != len(text or ""):  # positions must hold in the text as given
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hot = {w for w in set(low.split()) if self.matched(w)}
        if not hot:
            return []
        out = []
        for a, b in sentences(low):
            if got := {f for w in low[a:b].split() for f in self.matched(w)}:
                out.append((a, b, tuple(sorted(got))))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (begin, end, score) of the sentences that hold any feature."""
        spans, clean = [], 1 - self.leak
        for a, b, got in self.instances(text):
            s = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in got)))))
            clean *= 1 - s
            spans.append((a, b, s))
        return 1 - clean, spans


def _learn(bags: list[tuple[int, float, list[tuple[str, ...]]]], start: dict[str, float], penalty: float, steps: int = 300) -> Model:
    """Penalised likelihood of the document labels under noisy-or, by Adam on the sentence weights; bags: (label, rows that it stands for, sentences)."""
    names = {f: i for i, f in enumerate(sorted(start))}
    y, copies = np.array([b[0] for b in bags], dtype=float), np.array([b[1] for b in bags], dtype=float)
    inst_doc = np.array([d for d, (_, _, xs) in enumerate(bags) for _ in xs], dtype=np.int64)
    sizes = np.array([len(x) for _, _, xs in bags for x in xs], dtype=np.int64)
    inst = np.repeat(np.arange(len(sizes)), sizes)
    feat = np.array([names[f] for _, _, xs in bags for x in xs for f in x], dtype=np.int64)
    theta = np.array([start[f] for f in sorted(start)] + [-2.0, -4.0])
    m1, m2, n = np.zeros_like(theta), np.zeros_like(theta), len(names)
    for step in range(1, steps + 1):
        w, bias, leak = theta[:n], theta[n], theta[n + 1]
        s = 1 / (1 + np.exp(-np.clip(bias + np.bincount(inst, weights=w[feat], minlength=len(sizes)), -30, 30)))
        lam = 1 / (1 + math.exp(-leak))
        log_q = np.bincount(inst_doc, weights=np.log1p(-np.minimum(s, 1 - 1e-9)), minlength=len(y)) + math.log1p(-lam)
        q = np.exp(log_q)
        slope = np.where(y > 0.5, -q / np.maximum(1 - q, 1e-6), 1.0) * copies
        gz = slope[inst_doc] * s
        g = np.concatenate([np.bincount(feat, weights=gz[inst], minlength=n), [gz.sum(), slope.sum() * lam]]) / copies.sum()
        g[:n] += penalty * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, float(theta[n]), float(1 / (1 + math.exp(-theta[n + 1]))))


def _loss(model: Model, bags: list[tuple[int, int, list[tuple[str, ...]]]]) -> float:
    """Minus the log likelihood of the labels."""
    out = 0.0
    for y, n, xs in bags:
        clean = 1 - model.leak
        for x in xs:
            clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, model.bias + sum(model.weights[f] for f in x)))))
        out -= n * math.log(max(1e-6, 1 - clean if y else clean))
    return out


def _chosen_penalty(bags: list[tuple[int, int, list[tuple[str, ...]]]], start: dict[str, float]) -> float:
    """The penalty of the least loss on rows left out; the least one where a class has fewer rows than there are folds."""
    place = [0] * len(bags)
    for y in (0, 1):
        own = [i for i, b in enumerate(bags) if b[0] == y]
        if len(own) < FOLDS:
            return PENALTIES[0]
        for k, i in enumerate(own):
            place[i] = k % FOLDS
    part = lambda k, out: [b for b, p in zip(bags, place, strict=True) if (p == k) == out]
    return min(PENALTIES, key=lambda c: sum(_loss(_learn(part(k, False), start, c, 150), part(k, True)) for k in range(FOLDS)))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from a bounded sample of labelled rows outside the held-out remainder."""
    rows = in_batches(docs).select("doc_id", "text").join(F.broadcast(sampled_labels(labels, "toxic", modulus, held, per_class)), "doc_id")
    words = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    rows = rows.groupBy(words.alias("words"), "y").agg(F.min(F.struct("doc_id", "text")).alias("r"), F.count("*").alias("n"), F.max("w").alias("w")).select("r.*", "y", "n", "w")
    sizes = {r.y: r for r in rows.groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("w")).alias("all")).collect()}
    pos, neg = (sizes[y].n if y in sizes else 0 for y in (1, 0))
    true = [sizes[y]["all"] if y in sizes else 0 for y in (1, 0)]
    constant = Model({}, -9.0, (true[0] + 1) / (sum(true) + 2))
    if not pos or not neg:
        return constant
    a, b = F.col("pos"), F.col("neg")
    rate = (a + 0.5) / (b + 0.5) * (neg / pos)
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    whole = a + b
    ratio = part(a, whole * (pos / (pos + neg))) + part(b, whole * (neg / (pos + neg)))
    counts = (
        rows.select("text", "y", "n")
        .mapInPandas(_document_frequencies, "feature string, neg long, pos long")
        .groupBy("feature")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .withColumn("g", ratio)
        .filter(rate > 1)
    )
    for enough in ((a >= 2) & (rate >= 3) & (F.col("g") > LEAST_RATIO), F.lit(True)):
        chosen = counts.filter(enough).orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature", rate.alias("rate")).collect()
        if chosen:
            break
    start = {r.feature: math.log(r.rate) / 2 for r in chosen}
    if not start:
        return constant
    finder = Model(start, 0.0, 0.0)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "n": pdf["n"] * pdf["w"], "bag": [[list(x) for x in sorted({f for _, _, f in finder.instances(t)})] for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInPandas(bags, f"doc_id {kind}, y int, n double, bag array<array<string>>").collect(), key=lambda r: (r.doc_id, r.y, r.bag))
    learnt = [(r.y, r.n, [tuple(x) for x in r.bag]) for r in got]
    return _learn(learnt, start, _chosen_penalty(learnt, start))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the spans (begin, end, score) of offending sentences (score of 0.5 or more) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.score(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"], "score": [s for s, _ in got], "offending": [[{"begin": a, "end": b, "score": x} for a, b, x in spans if x >= 0.5] for _, spans in got]}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, offending array<struct<begin:int,end:int,score:double>>")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending and the worst sentence's place for every row of docs."""
    out = scored(docs, train(docs, labels, modulus, held))
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["score"], -x["begin"], x["end"])))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
        (-worst["col2"]).alias("worst_begin"),
        worst["end"].alias("worst_end"),
    )
