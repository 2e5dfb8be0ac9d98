"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text (each run of non-letters counts as one blank), tf-scaled to unit
length. Families are a parameter (ISO 639-1 codes; an unlisted code is a family of its own). The family step is a set of
one-versus-rest linear SVMs, the step inside a family has one SVM for each pair of its languages, and votes weighed by their
logistic margins decide. Training data are hash-chosen rows, at most `max_rows`, about as many of each language; their hashed
features are computed on executors.

Defined cases: null, empty or letterless texts are `und` with score 0; so is all text if nothing could be learned; one
learned language is predicted everywhere with score 1; null langs train nothing; repeated rows predict alike and are chosen
for training together (the choice hashes id and text, so rows that only share an id are chosen apart); an empty table gives an
empty result; texts count whole, whatever their length; further columns are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm._shared import over_texts, table

DIMS, MAX_ROWS, STEPS, RIDGE = 1 << 12, 2400, 150, 1e-3
#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"), "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"), "uralic": ("fi", "et", "hu"), "turkic": ("tr", "az", "kk"), "semitic": ("ar", "he"),
}
#: Bytes of letters keep their value, all others become a blank.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def trigrams(raw: bytes) -> np.ndarray:
    """Unit vector of log-scaled hashed trigram counts; all zero without a letter."""
    b = LETTERS[np.frombuffer(raw.decode("utf-8", "replace").lower().encode(), np.uint8)]
    out = np.zeros(DIMS, np.float32)
    if not len(b) or b.max() == 32 and b.min() == 32:
        return out
    b = np.concatenate([[32], b[(b != 32) | np.r_[True, b[:-1] != 32]], [32]]).astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) if len(b) > 2 else np.zeros(0, np.uint32)
    counts = np.log1p(np.bincount((code ^ (code >> 15)) & (DIMS - 1), minlength=DIMS)).astype(np.float32)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def has_letter(raw: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in raw[:64]):
        return True
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a class-balanced squared-hinge SVM, by accelerated gradient steps. y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2.0 + RIDGE)  # rows have squared length 2 at most, weights sum to 1
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (RIDGE * v - 2 * (x.T @ (c * y * slack)))
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class LangModel:
    families: list[list[str]] = field(default_factory=list)
    family_w: np.ndarray | None = None
    pair_w: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not rows or not self.families:
            return langs, scores
        x = np.array([np.append(trigrams(texts[i]), np.float32(1)) for i in rows], np.float32)
        chance = lambda m: 1 / (1 + np.exp(-4 * m))
        if len(self.families) > 1:
            p = chance(x @ self.family_w.T)
            p /= p.sum(axis=1, keepdims=True)
        else:
            p = np.ones((len(rows), 1))
        family = p.argmax(axis=1)
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            votes = np.zeros((len(at), len(members)))
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                q = chance(x[at] @ self.pair_w[a, b])
                votes[:, i] += q
                votes[:, j] += 1 - q
            best = votes.argmax(axis=1)
            share = votes[np.arange(len(at)), best] / max(1, len(members) - 1) if len(members) > 1 else np.ones(len(at))
            for k, b, s in zip(at.tolist(), best.tolist(), (p[at, f] * share).tolist(), strict=True):
                langs[rows[k]], scores[rows[k]] = members[b], float(min(1.0, max(0.0, s)))
        return langs, scores


def fit(x: np.ndarray, lang: np.ndarray, families: dict[str, tuple[str, ...]] | None = None) -> LangModel:
    of = {code: name for name, codes in (families or FAMILIES).items() for code in codes}
    known = sorted(set(lang.tolist()))
    grouped = [sorted(g) for _, g in itertools.groupby(sorted(known, key=lambda c: (of.get(c, f"~{c}"), c)), key=lambda c: of.get(c, f"~{c}"))]
    model = LangModel(families=grouped)
    if len(grouped) > 1:
        model.family_w = np.array([svm(x, np.where(np.isin(lang, g), 1, -1).astype(np.float32)) for g in grouped])
    for g in grouped:
        for a, b in itertools.combinations(g, 2):
            rows = np.isin(lang, (a, b))
            model.pair_w[a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32))
    return model


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LangModel:
    """docs (doc_id, text, lang), labelled rows only."""
    rows = docs.where("lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("_li_h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LangModel()
    each = max(1, max_rows // len(counts))
    # hashes below a share of their range choose about `each` rows of a language, in one pass
    below = F.lit(0.0)
    for code, n in counts.items():
        below = F.when(F.col("lang") == code, float(min(1.0, each / n))).otherwise(below)
    chosen = rows.where((F.pmod("_li_h", F.lit(1 << 30)) / float(1 << 30)) < below).orderBy("_li_h", "lang").limit(2 * max_rows)
    vector = over_texts(lambda t: pa.array([trigrams(x).tobytes() for x in t], pa.binary()), "binary")
    got = chosen.select("_li_h", "lang", vector(F.col("text")).alias("x")).toPandas().sort_values(["_li_h", "lang"], kind="stable")
    if got.empty:
        return LangModel()
    return fit(np.array([np.frombuffer(b, np.float32) for b in got["x"]]), got["lang"].to_numpy())


def predictions(model: LangModel):
    """The column function text -> struct of lang_pred and score."""

    def run(texts: list[bytes]) -> pa.Array:
        langs, scores = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return over_texts(run, "struct<lang_pred: string, score: double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    return docs.select("doc_id", held.alias("held_out"), predictions(model)(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
