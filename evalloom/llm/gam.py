"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round by round, each feature in turn gets a shallow tree (depth 2) on its binned values, fitted to the
log-loss gradient and added to the feature's lookup table. Then the pairs with the largest residual gain get tables
of their own in the same way. Scoring bins the features of a batch and adds table entries.

The model is fitted on the driver from at most `max_rows` labelled rows (those with the least hashes of their ids); their
features, not their texts, are collected. Features and scores take whole texts.

Defined cases: a null text is an empty one and gets a score; labels that are null don't take part; without labels the score
is 0.5, with one class it is the smoothed prior; a document labelled twice trains twice; repeated rows score alike.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import over_texts, table

#: Bound of the rows that training takes; they are a few MB on the driver.
MAX_ROWS = 12_000
THRESHOLD, BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 0.3, 32, 12, 120, 60, 6, 0.15, 4.0
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "upper_words", "title_words", "exclamations", "question_marks", "stops", "commas", "word_variety",
    "echoes", "digits", "log_lines", "repeated_lines", "end_mark", "non_ascii", "longest_word",
)


def features(raw: bytes) -> list[float]:
    text = raw.decode("utf-8", "replace")
    words, lines, count = text.split(), text.split("\n"), text.count
    n, chars = len(words) or 1, len(text) or 1
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, sum(map(count, "#*$%&<>")) / n, count("|") / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        count("!") / n, count("?") / n, count(".") / n, count(",") / n, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, sum(map(count, "0123456789")) / chars,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), float(text.rstrip()[-1:] in tuple(".!?\"'")), (len(raw) - len(text)) / chars, float(max(map(len, words), default=0)),
    ]


def tree_1d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values on each bin of a depth-2 tree fitted to gradient sums g and hessian sums h."""

    def best(lo: int, hi: int) -> int:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return hi
        gain = a**2 / (b + SMOOTH) + (g[lo:hi].sum() - a) ** 2 / (h[lo:hi].sum() - b + SMOOTH)
        return lo + 1 + int(np.argmax(gain)) if gain.max() > g[lo:hi].sum() ** 2 / (h[lo:hi].sum() + SMOOTH) + 1e-9 else hi

    out, n = np.zeros(len(g)), len(g)
    mid = best(0, n)
    cuts = sorted({0, best(0, mid), mid, *([best(mid, n)] if mid < n else []), n})
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + SMOOTH)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values on a grid of bins of a tree that splits on one axis, then each side on the better axis; and its gain."""

    def split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        found = (g.sum() ** 2 / (h.sum() + SMOOTH), -1, 0)
        for axis in (0, 1):
            a, b = np.cumsum(g.sum(axis=1 - axis))[:-1], np.cumsum(h.sum(axis=1 - axis))[:-1]
            if len(a):
                gain = a**2 / (b + SMOOTH) + (g.sum() - a) ** 2 / (h.sum() - b + SMOOTH)
                found = max(found, (float(gain.max()), axis, int(np.argmax(gain)) + 1))
        return found

    out, total = np.zeros(g.shape), 0.0
    _, axis, at = split(g, h)
    sides = [(slice(None), slice(None))] if axis < 0 else [(slice(0, at), slice(None)), (slice(at, None), slice(None))] if axis == 0 else [(slice(None), slice(0, at)), (slice(None), slice(at, None))]
    for side in sides:
        gs, hs, o = g[side], h[side], out[side]
        gain, axis, at = split(gs, hs)
        total += gain
        if axis < 0:
            o[:] = gs.sum() / (hs.sum() + SMOOTH)
        else:
            for part in (slice(0, at), slice(at, None)):
                x = (part, slice(None)) if axis == 0 else (slice(None), part)
                o[x] = gs[x].sum() / (hs[x].sum() + SMOOTH)
    return out, total


@dataclass
class Gam:
    bias: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += values[np.searchsorted(cuts, x[:, j], side="left")]
        for i, j, values in self.pairs:
            z += values[np.searchsorted(self.pair_cuts[i], x[:, i], side="left"), np.searchsorted(self.pair_cuts[j], x[:, j], side="left")]
        return 1 / (1 + np.exp(-z))


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    if not len(y):
        return Gam()
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(bias=float(np.log(prior / (1 - prior))))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.cuts = [edges(x[:, j], BINS) for j in range(d)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(model.cuts)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * tree_1d(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            z += step[bins[j]]
    model.pair_cuts = [edges(x[:, j], PAIR_BINS) for j in range(d)]
    coarse = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(model.pair_cuts)]
    width = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    gains = sorted(((tree_2d(grid(i, j, g), grid(i, j, h))[1], -i, -j) for i in range(d) for j in range(i + 1, d)), reverse=True)
    model.pairs = [(-i, -j, np.zeros((width[-i], width[-j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model.pairs:
            g, h = slopes()
            step = RATE * tree_2d(grid(i, j, g), grid(i, j, h))[0]
            values += step
            z += step[coarse[i], coarse[j]]
    return model


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """docs (doc_id, text), labels (doc_id, quality): a model of quality = 1."""
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("_gam_id"), F.col("quality").cast("int").alias("_gam_y"))
    chosen = chosen.orderBy(F.xxhash64("_gam_id"), "_gam_id", "_gam_y").limit(max_rows)
    vector = over_texts(lambda t: pa.array(list(matrix(t)), pa.list_(pa.float64())), "array<double>")
    rows = docs.join(F.broadcast(chosen), docs.doc_id == chosen["_gam_id"])
    rows = rows.select("_gam_id", "_gam_y", F.xxhash64("_gam_id", "text").alias("k"), vector(F.col("text")).alias("x"))
    got = rows.orderBy("k", "_gam_id", "_gam_y").limit(max_rows).toPandas()  # an id may have many rows
    got = got.sort_values(["_gam_id", "_gam_y", "k"], kind="stable")
    return fit(np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES)), got["_gam_y"].to_numpy(float))


def scores(model: Gam):
    """The column function text -> score of a fitted model."""
    return over_texts(lambda t: pa.array(model.score(matrix(t)), pa.float64()), "double")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Gam:
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, sf_dir, docs)
    out = docs.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), scores(model)(F.col("text")).alias("score"))
    return out.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
