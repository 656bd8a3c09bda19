"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its words and their first ``PREFIXES`` letters, which
find the inflected forms of a word; a feature's value is log2(1 + count). All
grades share one weight for each feature and differ by ordered thresholds:
P(grade >= k) = logistic(w.x - t_k). Expected severity is the sum of these
over k, and a text is rejected when grade 1 or more is likelier than not.

The labels tell toxic from clean only. Grades of toxic rows therefore come
from how many words they have that mark toxic rows: the sample's toxic
rows fall into ``GRADES`` - 1 equal parts. With a label column of several
grades those are used as they are.

The model is fit on at most ``SAMPLE`` labelled rows, those with the smallest
hash of their id. Their words are counted on the executors, and the driver gets every
feature that marks (a z score of ``Z`` or more) and the sample's counts of those, kept sparse: what it
holds grows with the sample's words and not with the tables. Every document is scored on its whole text, in Arrow batches.

Defined results: a null or empty text has no features and the grade of the
thresholds alone; null labels and labels without a document are not used; of
several labels of a document each counts; without labels of two grades
everything is grade 0; repeated rows and null ids are scored like others; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

SAMPLE = 6000
GRADES = 4
RARE = 3
Z = 3.5
PENALTY = 0.3
STEPS = 500
RATE = 0.05
PREFIXES = range(3, 9)
CACHE = 500_000
_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def named(word: str) -> list[str]:
    """The features of a word: itself, and its first letters with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


Row = tuple[int, dict[str, int], int]


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """(label, words, counts) of at most ``most`` labelled rows, as a written table."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("l_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id", "label").limit(most)

    def run(batches):
        for batch in batches:
            found = [Counter(words(t)) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "words", "counts"])

    rows = docs.select(F.col(f"`{key}`").alias("d_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    return written(rows.select("label", "text").mapInArrow(run, "label int, words array<string>, counts array<int>"), "toxicity-sample")[0]


def marking(rows: DataFrame, rare: int = RARE, z: float = Z) -> dict[str, float]:
    """All features that tell rows of grade 1 or more from others, with the z score of their log odds."""

    def run(batches):
        for batch in batches:
            held = [Counter(), Counter()]
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[label > 0].update({f for w in found for f in named(w)})
            names = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h[n] for n in names], pa.int64()) for h in held)], ["feature", "a", "b"])

    total = rows.agg(F.count_if(F.col("label") <= 0).alias("clean"), F.count_if(F.col("label") > 0).alias("toxic")).first()
    counts = rows.select("label", "words").mapInArrow(run, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= rare)
    a, b, not_a, not_b = F.col("a") + 0.5, F.col("b") + 0.5, total.clean - F.col("a") + 0.5, total.toxic - F.col("b") + 0.5
    score = (F.log(b / not_b) - F.log(a / not_a)) / F.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b)
    return {r.feature: r.z for r in counts.select("feature", score.alias("z")).where(F.abs("z") >= z).collect()}


def marked(rows: DataFrame, marks: dict[str, float]) -> list[Row]:
    """(label, counts of the marking features, number of words with one that marks toxic rows) of each sample row."""

    def run(batches):
        for batch in batches:
            out = [as_row(label, dict(zip(w, n, strict=True)), marks) for label, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = [pa.array([r[0] for r in out], pa.int32()), pa.array([list(r[1]) for r in out], pa.list_(pa.string())), pa.array([list(r[1].values()) for r in out], pa.list_(pa.int32())), pa.array([r[2] for r in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["label", "features", "counts", "hits"])

    got = rows.mapInArrow(run, "label int, features array<string>, counts array<int>, hits long").collect()
    return [(r.label, dict(zip(r.features, r.counts, strict=True)), r.hits) for r in sorted(got)]


def as_row(label: int, found: dict[str, int], marks: dict[str, float]) -> Row:
    out: dict[str, int] = {}
    hits = 0
    for w, n in found.items():
        some = [f for f in named(w) if f in marks]
        for f in some:
            out[f] = out.get(f, 0) + n
        hits += n * any(marks[f] > 0 for f in some)
    return label, out, hits


def graded(rows: list[Row], grades: int = GRADES) -> np.ndarray:
    """The labels if they have several grades, else toxic rows by how many marking words they have."""
    label = np.array([r[0] for r in rows])
    if label.max(initial=0) > 1:
        return label
    hits = np.array([r[2] for r in rows])
    edges = np.quantile(hits[label > 0], np.arange(1, grades - 1) / (grades - 1))
    return np.where(label > 0, 1 + np.searchsorted(edges, hits, side="right"), 0)


class Ordinal:
    """Shared weights by word, and the ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.asarray(thresholds, float)

        self.seen: dict[str, tuple[str, ...]] = {}

    def latent(self, found: list[str]) -> float:
        """w.x of a text's words; a bounded cache remembers which features each word has."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        for w in set(found).difference(self.seen):
            self.seen[w] = tuple(f for f in named(w) if f in self.weights)
        held = Counter(f for fs in filter(None, map(self.seen.__getitem__, found)) for f in fs)
        return sum(self.weights[f] * math.log2(1 + held[f]) for f in sorted(held))

    def above(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each k, a row for each latent value."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -50, 50)))


def fit(rows: list[Row], marks: dict[str, float], grades: int = GRADES, penalty: float = PENALTY, steps: int = STEPS, rate: float = RATE) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by Adam on weights and threshold gaps."""
    if len({r[0] > 0 for r in rows}) < 2:
        return Ordinal({}, [50.0])
    y = graded(rows, grades)
    kinds = sorted(set(y.tolist()))
    y = np.searchsorted(kinds, y)
    k, names = len(kinds) - 1, sorted(marks)
    at = {w: i for i, w in enumerate(names)}
    cells = sorted((at[w], i, math.log2(1 + n)) for i, (_, found, _) in enumerate(rows) for w, n in found.items() if w in at)
    col, row = (np.array([c[k] for c in cells], np.int64) for k in (0, 1))
    value = np.array([c[2] for c in cells], float)
    edges = np.searchsorted(col, np.arange(len(names) + 1))
    column = lambda j: (row[edges[j] : edges[j + 1]].tobytes(), value[edges[j] : edges[j + 1]].tobytes())
    # of features with the same values throughout the sample the most specific stands for all
    last = {column(j): j for j in sorted(range(len(names)), key=lambda j: (len(names[j]), names[j][-1:] != "*"))}
    kept = np.array(sorted(last.values()), np.int64)
    mine = np.isin(col, kept)
    col, row, value, names = np.searchsorted(kept, col[mine]), row[mine], value[mine], [names[j] for j in kept]
    share = np.array([(y >= j).mean() for j in range(1, k + 1)])
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m = v = np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[: len(names)], np.exp(p[len(names) + 1 :])
        t = np.concatenate([p[len(names) : len(names) + 1], p[len(names)] + np.cumsum(gaps)])
        z = np.bincount(row, value * w[col], len(y))
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None, :], -50, 50)))
        full = np.hstack([np.ones((len(y), 1)), s, np.zeros((len(y), 1))])
        i = np.arange(len(y))
        hi, lo = full[i, y], full[i, y + 1]
        prob = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_w = -np.bincount(col, value * (d_hi - d_lo)[row], len(names)) / len(y) + penalty / len(y) * w
        g_t = np.zeros(k)
        np.add.at(g_t, y[y > 0] - 1, d_hi[y > 0] / len(y))
        np.add.at(g_t, y[y < k], -d_lo[y < k] / len(y))
        g = np.concatenate([g_w, [g_t.sum()], gaps * np.cumsum(g_t[:0:-1])[::-1] if k > 1 else []])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    gaps = np.exp(p[len(names) + 1 :])
    t = np.concatenate([p[len(names) : len(names) + 1], p[len(names)] + np.cumsum(gaps)])
    return Ordinal(dict(zip(names, p[: len(names)].tolist(), strict=True)), t.tolist())


def scored(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every row."""

    def run(batches):
        for batch in batches:
            latent = np.array([model.latent(words(t)) for t in batch.column(1).to_pylist()], float)
            above = model.above(latent)
            cols = [batch.column(0), pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def trained(docs: DataFrame, labels: DataFrame) -> Ordinal:
    rows = sample(docs, labels)
    marks = marking(rows)
    return fit(marked(rows, marks), marks)


def rejected_removed(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    at = docs.columns.index(text)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))

    def run(batches):
        for batch in batches:
            latent = np.array([model.latent(words(t)) for t in batch.column(at).to_pylist()], float)
            yield batch.filter(pa.array(model.above(latent)[:, 0] < 0.5))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
