"""Language identification.

A sparse multinomial logistic regression on TF-IDF character n-grams (1 to 3
code points, hashed), trained by follow-the-regularised-leader with an
elastic-net penalty, then calibrated by a temperature on examples kept apart.

Document frequencies cover every training text. The regression itself learns
from a bounded sample: PER_LANG different texts of each language at most (all of
them where there are fewer), those with the smallest hashes. The model has a
row of weights for each language, so the driver and the tasks hold as many rows
as there are values of lang.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.common import lean, short_batches

#: Training examples of a language (the bound of the fitting sample).
PER_LANG = 1000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
UND = "und"


class Ftrl:
    """Multinomial FTRL-proximal with per-coordinate rates; the last row of features is the intercept."""

    def __init__(self, classes: int, dim: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((classes, dim + 1)), np.zeros((classes, dim + 1))
        self.alpha, self.beta, self.l1, self.l2, self.dim = alpha, beta, l1, l2, dim

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, self.dim), np.append(x, 1.0)
        w = self.weights(at)
        s = w @ x
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on held-back scores, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        top = s.max(1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(1)) - s[np.arange(len(y)), y]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temp: float):
        self.langs, self.idf, self.weights, self.temp = langs, idf, weights, temp

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UND, 0.0
        at, tf = features.sparse(text.lower())
        s = (self.weights[:, at] @ features.weighted(at, tf, self.idf) + self.weights[:, -1]) / self.temp
        p = np.exp(s - s.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, text_col="text", lang_col="lang", per_lang: int = PER_LANG) -> Model:
    """Learns from the rows of docs that have a text and a language.

    Rows with a null in either are left out; without any row left, the model
    says ``und`` to everything. Ids play no part: null and repeated ids learn
    like others, and a text that comes again counts once a language in the
    sample. Other columns of docs are ignored.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_text is not null and _lang is not null")
    draw = F.xxhash64("_text", F.lit("langid"))
    sizes = dict(rows.groupBy("_lang").agg(F.approx_count_distinct(draw, 0.02)).collect())  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(features.DIM, np.float32), np.zeros((0, features.DIM + 1), np.float32), 1.0)
    df, n = features.document_frequency(rows.select("_text"), lower=True)
    idf = features.idf_of(df, n)
    sample = features.collect_sparse(features.smallest(rows, "_lang", draw, sizes, per_lang).select("_lang", "_text"), lower=True)
    order = np.random.default_rng(11).permutation(len(sample))
    number = {x: i for i, x in enumerate(langs)}
    examples = [(number[sample[i][0]], sample[i][1], features.weighted(sample[i][1], sample[i][2], idf)) for i in order]
    held, learnt = examples[::5], [e for i, e in enumerate(examples) if i % 5]
    ftrl = Ftrl(len(langs), features.DIM)
    for _ in range(EPOCHS):
        for y, at, x in learnt:
            ftrl.learn(at, x, y)
    w = ftrl.weights().astype(np.float32)
    scores = np.array([w[:, at] @ x + w[:, -1] for _, at, x in held]).reshape(len(held), len(langs))
    return Model(langs, idf, w, temperature(scores, np.array([y for y, _, _ in held], int)))


def identify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, lang_pred, score) for every row of docs; with keep, rows (keep..., text, lang_pred, score).

    Null texts and texts without a letter get ``und`` and score 0; long texts
    count whole. Of languages of equal score the first in order is told.
    Repeated rows repeat, null ids stay null, other columns of docs are ignored;
    an empty table gives none.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIM weights, whatever the input
    passed = [F.col(c).alias(f"_{i}") for i, c in enumerate((*keep, text_col) if keep else (id_col,))]
    rows = docs.select(F.col(text_col).alias("_text"), *passed)
    kinds = dict(rows.dtypes)
    names = [c for c in rows.columns if c != "_text"]

    def task(batches):
        m = shared.value
        for batch in batches:
            got = [m.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, "lang_pred", "score"])

    out = rows.mapInArrow(lean(task), ", ".join([*(f"{c} {kinds[c]}" for c in names), "lang_pred string", "score double"]))
    return out.toDF(*((*keep, text_col) if keep else (id_col,)), "lang_pred", "score")


def held_out(id_col="doc_id") -> Column:
    """True for the documents that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
