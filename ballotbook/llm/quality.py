"""Quality scores by a sparse ensemble of tree-path rules.

Statistics of the whole text are computed per document. Small boosted trees are grown on a bounded sample of
labelled documents; every path from a root is a conjunctive rule over the statistics. A lasso logistic fit
keeps few of the rules. The kept rules are compiled into one Spark column expression, so scoring any number
of documents is a projection.

Null and empty texts have statistics of zero and a score like any other. Labels other than 0 and 1, and
labels of unknown documents, are left out of the fit; of repeated ones each counts. Without labels of both
kinds every score is the share of ones (0.5 without labels). Repeated documents are each scored; a null
doc_id is never held out. Of further columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .workspace import Workspace

STATISTICS = (
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "shout", "stop", "short", "distinct",
    "repeats", "line_repeats", "line_words", "high_bytes",
)
#: Rows of the labelled sample; the fit's time and memory do not depend on the corpus beyond it.
SAMPLE = 6000

_byte = np.arange(256)
_UPPER = (_byte >= 0x41) & (_byte <= 0x5A)
_LOWER = (_byte >= 0x61) & (_byte <= 0x7A)
_DIGIT = (_byte >= 0x30) & (_byte <= 0x39)
_ENDS = np.isin(_byte, [ord(c) for c in ".,;:?"])
_SYMBOL = np.isin(_byte, [ord(c) for c in "#$%&*+<=>@[]^_{}~\\/"])
_BAR, _SHOUT, _HIGH = _byte == ord("|"), _byte == ord("!"), _byte >= 0x80
_LINE = ~((_byte == 0x0A) | (_byte == 0x0D))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text of a chunk."""
    starts, ends, hashes, counts = W.split_words(data, offsets, W.SPACED)
    edges = np.concatenate([[0], np.cumsum(counts)])
    rows = W.rows_of(counts)
    n = len(counts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = np.maximum(counts, 1).astype(float)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return np.diff(sums[offsets]).astype(float)

    upper, lower, high = share(_UPPER), share(_LOWER), share(_HIGH)
    letters = np.maximum(upper + lower + high, 1)
    lengths = (ends - starts).astype(float)
    # C3 80 to C3 9E are capital letters beyond A-Z
    accents = np.zeros(n)
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        accents = np.bincount(np.searchsorted(offsets, capital, side="right") - 1, minlength=n)[:n].astype(float)
    same = np.zeros(len(hashes))
    for k in (1, 2):
        if len(hashes) > k:
            same[k:] += (hashes[k:] == hashes[:-k]) & (rows[k:] == rows[:-k])
    sets = np.array([len(np.unique(hashes[edges[k] : edges[k + 1]])) for k in range(n)], float)
    _, _, line_hashes, line_counts = W.split_words(data, offsets, _LINE)
    line_edges = np.concatenate([[0], np.cumsum(line_counts)])
    line_sets = np.array([len(np.unique(line_hashes[line_edges[k] : line_edges[k + 1]])) for k in range(n)], float)
    lines = np.maximum(line_counts, 1).astype(float)
    return np.column_stack(
        [
            np.log1p(counts),
            np.bincount(rows, lengths, minlength=n) / words,
            (upper + accents) / letters,
            share(_DIGIT) / size,
            share(_SYMBOL) / size,
            share(_BAR) / words,
            share(_SHOUT) / words,
            share(_ENDS) / words,
            np.bincount(rows, lengths <= 3, minlength=n) / words,
            sets / words,
            np.bincount(rows, same > 0, minlength=n) / words,
            1 - line_sets / lines * (line_counts > 0) - (line_counts == 0),
            np.log1p(counts / lines),
            high / size,
        ]
    )


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one double per statistic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(1)):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], *(pa.array(found[:, k]) for k in range(len(STATISTICS)))],
                    names=["doc_id", *STATISTICS],
                )

    schema = ", ".join(["doc_id long", *(f"{s} double" for s in STATISTICS)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is greater, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, prefix: str = "") -> Column:
        parts = [
            (F.col(prefix + STATISTICS[k]) > F.lit(t)) if above else (F.col(prefix + STATISTICS[k]) <= F.lit(t))
            for k, above, t in self.terms
        ]
        return reduce(lambda a, b: a & b, parts)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 32, least: int = 10) -> list[Rule]:
    """Every path of boosted regression trees on the logistic gradient."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        nodes = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            below = []
            for rows, terms in nodes:
                total, weight = slope[rows].sum(), curve[rows].sum() + 1.0
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    for k, c in enumerate(cuts):
                        if not len(c):
                            continue
                        b = binned[rows, k]
                        g = np.cumsum(np.bincount(b, slope[rows], minlength=len(c) + 1))[:-1]
                        h = np.cumsum(np.bincount(b, curve[rows], minlength=len(c) + 1))[:-1]
                        m = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                        gain = g**2 / (h + 1) + (total - g) ** 2 / (weight - h) - total**2 / weight
                        gain[(m < least) | (len(rows) - m < least)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), (k, int(gain.argmax())))
                if best[1] is None:
                    score[rows] += 0.3 * total / weight
                    continue
                k, j = best[1]
                above = binned[rows, k] > j
                for side in (False, True):
                    own = (*terms, (k, side, float(cuts[k][j])))
                    rules.setdefault(Rule(own))
                    below.append((rows[above == side], own))
            nodes = below
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient descent."""
    n, m = z.shape
    z = np.column_stack([np.ones(n), z])
    v = np.random.default_rng(0).normal(size=m + 1)
    for _ in range(15):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(z @ v) ** 2 / n * 1.05)
    w = np.zeros(m + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - step * (z.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_next * (new - w), new, t_next
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    """The kept rules, their weights and the intercept."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * r.values(x) for w, r in self.rules), np.zeros(len(x))))))

    def column(self, prefix: str = "") -> Column:
        """The score as a Spark expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for w, rule in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.0008) -> RuleModel:
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return RuleModel(float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), ())
    rules = tree_rules(x, y)
    z = np.column_stack([r.values(x) for r in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    intercept, weights = lasso_logistic(z, y, penalty)
    kept = [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-4]
    return RuleModel(intercept, tuple(kept))


def held_out() -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit on the documents of at most ``sample`` labels, the first in hash order of their ids."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("quality in (0, 1)")
        .filter(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample)
    )
    chosen = docs.join(F.broadcast(marks.select("doc_id").distinct()), "doc_id", "left_semi")  # ``sample`` rows at most
    rows = document_statistics(chosen).join(F.broadcast(marks), "doc_id").select("doc_id", "quality", *STATISTICS).collect()
    values = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 2 + len(STATISTICS))
    return fit_rules(values[:, 2:], values[:, 1])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    Workspace(docs.sparkSession, "quality")
    model = train(docs, labels, sample)
    return (
        document_statistics(docs)
        .select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents with a score of ``threshold`` or more, all columns, in one pass without a join."""
    Workspace(docs.sparkSession, "quality-filter")
    model = train(docs, labels, sample)
    prefix = "__ballotbook_"
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.chunks(batch.column(at)):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c[first:end] for c in batch.columns),
                        *(pa.array(found[:, k]) for k in range(len(STATISTICS))),
                    ],
                    names=[*names, *(prefix + s for s in STATISTICS)],
                )

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"{prefix}{s} double" for s in STATISTICS])
    return docs.mapInArrow(run, schema).filter(model.column(prefix) >= threshold).select(*names)
