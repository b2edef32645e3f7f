"""Quality classifier: a sparse rule ensemble.

Shallow regression trees are boosted on statistics of whole texts; every path of a tree is a conjunctive
rule; an L1-penalised logistic regression keeps few of the rules; the kept rules are compiled into one
Spark column expression.  Statistics are counted in Arrow batches, the score is a JVM expression.

The fit reads a bounded sample of each class; a row counts as many rows as it stands for, so scores follow
the classes' true shares at every size.

Cases: a null text has the statistics of an empty one (all zero) and is scored; repeated rows are scored
each; without labelled rows, with one class only, or where no rule tells the rows apart (equal texts, null
texts), the score is the (smoothed) rate of label 1; extra columns of any name are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, remainder, sampled_labels

#: At most so many labelled rows of either class are fitted on (statistics only reach the driver, never texts).
SAMPLE_PER_CLASS = 6000

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next", "distinct_pairs", "upper_share", "digit_share",
    "symbol_share", "bang_share", "pipe_share", "stop_share", "line_share", "repeated_lines", "short_words", "non_ascii",
)

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@^~_=+<>/\\{}[]`"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    b = (text or "").encode("utf-8", "replace")
    words = b.lower().split()
    n, w = len(b), len(words)
    if not w:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    upper, high, letters = share(_UPPER), share(_HIGH), share(_LETTERS)
    lines = [x for x in b.split(b"\n") if x]
    return [
        math.log1p(n), math.log1p(w), n / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / max(1, w - 1), upper / max(letters, 1e-9), share(_DIGITS), share(_SYMBOLS), share(b"!"),
        share(b"|"), b.count(b".") / w, len(lines) / w, 1 - len(set(lines)) / max(1, len(lines)), b.count(b" ") / n, high,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


#: A rule: conditions (statistic, is "at most", threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: Rule, out: list, least: int) -> None:
    """Grow a regression tree by exact search over the cut points; out gets (rule, rows, mean) of each node below the root."""
    w, wt = weight[rows], (weight * target)[rows]
    total, mass, count = wt.sum(), w.sum(), len(rows)
    best = (1e-9, -1, 0)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        size, low, gain = (np.bincount(bins[rows, f], weights=v, minlength=len(cut) + 1).cumsum()[:-1] for v in (None, w, wt))
        ok = (size >= least) & (count - size >= least)
        if ok.any():
            score = np.where(ok, gain**2 / np.maximum(low, 1) + (total - gain) ** 2 / np.maximum(mass - low, 1) - total**2 / mass, -1)
            k = int(score.argmax())
            if score[k] > best[0]:
                best = (float(score[k]), f, k)
    _, f, k = best
    if f < 0:
        return
    for low in (True, False):
        side = rows[(bins[rows, f] <= k) == low]
        rule = (*path, (f, low, float(cuts[f][k])))
        leaf = depth == 1 or len(side) < 2 * least
        out.append((rule, side, float(np.average(target[side], weights=weight[side])), leaf))
        if not leaf:
            before = len(out)
            _tree(x, bins, cuts, target, weight, side, depth - 1, rule, out, least)
            if len(out) == before:
                out[-1] = (*out[-1][:3], True)


def _cuts(x: np.ndarray, most: int = 24) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0.02, 0.98, most), method="lower")) for c in x.T]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] <= t) == low for f, low, t in rule])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, [(rule, weight)]): rules from boosted trees, weights from a lasso logistic fit by accelerated proximal steps; weight: of each row."""
    weight = np.ones(len(y)) if weight is None else weight
    rate = (weight @ y + 1) / (weight.sum() + 2) if len(y) else 0.5
    base = math.log(rate / (1 - rate))
    if len(y) < 10 or y.min() == y.max():
        return base, []
    rng, cuts = np.random.default_rng(seed), _cuts(x)
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score, rules = np.full(len(y), base), {}
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(8, len(y) // 2), replace=False))
        nodes: list = []
        _tree(x, bins, cuts, y - 1 / (1 + np.exp(-score)), weight, rows, depth, (), nodes, max(3, len(y) // 500))
        for rule, _, mean, leaf in nodes:
            rules[tuple(sorted(rule))] = None
            if leaf:
                score += 0.8 * mean * _holds(x, rule)
    kept, seen = [], set()
    for rule in rules:
        column = _holds(x, rule)
        key = column.tobytes()
        if 0 < column.sum() < len(y) and key not in seen:
            seen.add(key)
            kept.append(rule)
    if not kept:
        return base, []
    m = np.stack([_holds(x, r) for r in kept], axis=1).astype(np.float32)
    centre, spread = m.mean(0), m.std(0)
    m = (m - centre) / spread
    w, b = np.zeros(m.shape[1], np.float32), base
    v, vb, t = w.copy(), b, 1.0
    share = (weight / weight.mean()).astype(np.float32)
    mw = m * np.sqrt(share)[:, None]
    step = 4.0 / (1 + np.linalg.norm(mw @ (mw.T @ np.ones(len(y), np.float32))) / len(y) / math.sqrt(len(y)) + _top(mw) / len(y))
    for _ in range(300):
        r = (share * (1 / (1 + np.exp(-(m @ v + vb))) - y)).astype(np.float32)
        nw = v - step * (m.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb, nt = vb - step * float(r.mean()), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    scaled = w / spread
    return float(b - scaled @ centre), [(r, float(c)) for r, c in zip(kept, scaled, strict=True) if c]


def _top(m: np.ndarray) -> float:
    """The largest squared singular value, by power iteration."""
    v = np.ones(m.shape[1], np.float32)
    for _ in range(12):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v)
    return float(np.linalg.norm(m @ v) ** 2)


def compiled(model: tuple[float, list[tuple[Rule, float]]], stats: Callable[[int], Column]) -> Column:
    """The model as one Spark expression over the statistics."""
    total = F.lit(model[0])
    for rule, weight in model[1]:
        condition = F.lit(True)
        for f, low, cut in rule:
            condition &= (stats(f) <= cut) if low else (stats(f) > cut)
        total += F.when(condition, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, per_class: int = SAMPLE_PER_CLASS):
    """Fit on labelled rows outside the held-out remainder; a sampled row weighs as many rows of its class as it stands for."""
    rows = (
        in_batches(docs).select("doc_id", "text")
        .join(F.broadcast(sampled_labels(labels, "quality", modulus, held, per_class)), "doc_id")
        .select("doc_id", "y", "w", statistics_of(F.col("text")).alias("s"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("y", "s", "w")).alias("r"))
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    x = np.array([r.r.s for r in rows], dtype=float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r.r.y for r in rows], dtype=float), np.array([r.r.w for r in rows], dtype=float))


#: A column of this name is added; tables do not bring one along.
SCORE = "__tarnwick_quality"


def scored(docs: DataFrame, model) -> DataFrame:
    """docs with the score in column SCORE; all columns of docs stay."""
    with_stats = in_batches(docs).withColumn("__tarnwick_stats", statistics_of(F.col("text")))
    return with_stats.withColumn(SCORE, compiled(model, lambda f: F.col("__tarnwick_stats")[f])).drop("__tarnwick_stats")


def accepted(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The rows of docs, in their own columns, whose score is least or more."""
    return scored(docs, model).filter(F.col(SCORE) >= least).drop(SCORE)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, modulus, held))
    return out.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
