"""Quality classification by nearest-neighbour voting.

Documents become latent-semantic vectors: TF-IDF of character n-grams (case
kept), projected on the leading singular directions of a labelled sample, and
two shares of repetition that damped counts hide. The labelled vectors are broadcast; every document's cosine products with all of
them are computed in blocks, exactly, and its K nearest vote with their labels
weighted by similarity.

The labelled sample is bounded: PER_LABEL different texts of each label at most,
by a hash of id and text. Document frequencies cover every text.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import features
from graphloom.llm.common import lean, short_batches

#: Labelled examples of a label (the bound of the fitting sample, and of what is broadcast).
PER_LABEL = 1200
RANK, K, POWER, BLOCK = 48, 25, 4.0, 512


def sparse_svd(rows: list[tuple[np.ndarray, np.ndarray]], dim: int, rank: int, seed=5, passes=2) -> np.ndarray:
    """dim x rank leading right singular vectors of a sparse matrix, by randomised subspace iteration."""
    rank = min(rank, max(1, len(rows)))
    q = np.random.default_rng(seed).standard_normal((dim, rank)).astype(np.float32)
    for _ in range(passes + 1):
        z = np.zeros((dim, rank), np.float32)
        for at, x in rows:
            z[at] += x[:, None] * (x @ q[at])
        q = np.linalg.qr(z)[0].astype(np.float32)
    return q


def repetition(text: str) -> np.ndarray:
    """Shares of words equal to the word before, and of lines equal to another line."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    return np.array([sum(map(eq, words, words[1:])) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))], np.float32)


class Model:
    def __init__(self, idf, basis, vectors, labels, prior):
        self.idf, self.basis, self.vectors, self.labels, self.prior = idf, basis, vectors, labels, prior

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1] + 2), np.float32)
        for i, t in enumerate(texts):
            if t:
                at, tf = features.sparse(t)
                out[i] = np.append(features.weighted(at, tf, self.idf) @ self.basis[at], repetition(t))
        return unit(out)

    def score(self, texts: list[str]) -> np.ndarray:
        """Weighted share of label 1 among the K nearest; the prior for texts without features."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        v = self.embed(texts)
        cos = v @ self.vectors.T
        k = min(K, cos.shape[1])
        # neighbours as near as the K-th, to six digits, vote with it
        cos = np.round(cos, 6)
        least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        w = np.where(cos >= least, np.maximum(cos, 0), 0).astype(np.float64) ** POWER
        total = w.sum(1)
        vote = w @ self.labels
        # one neighbour's worth of the prior keeps scores inside (0, 1)
        return np.where(total > 0, (vote + self.prior) / (total + 1), self.prior)


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", per_label: int = PER_LABEL) -> Model:
    """labels(id, label) with labels 0 and 1; others and nulls are left out.

    A document marked twice alike counts once, marked both ways once for each.
    Of rows of docs with one id each different text counts.
    """
    short_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    draw = F.xxhash64(F.col("_id").cast("string"), F.lit("quality"))
    sizes = dict(marks.groupBy("_y").agg(F.approx_count_distinct(draw, 0.02)).collect())  # two rows at most
    df, n = features.document_frequency(texts.select("_text"), lower=False)
    idf = features.idf_of(df, n)
    # PER_LABEL ids of each label at most, so they can be broadcast; then as many different texts of theirs
    sample = F.broadcast(features.smallest(marks, "_y", draw, sizes, per_label))
    found = texts.join(sample, "_id").filter("_text is not null")
    found = features.smallest(found, "_y", F.xxhash64("_text", F.lit("quality")), {y: 1 for y in sizes}, per_label)
    rows = features.collect_sparse(found.select("_y", "_text"), lower=False, extra=repetition)
    x = [(at, features.weighted(at, tf, idf)) for _, at, tf, _ in rows]
    y = np.array([r[0] for r in rows], np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y):
        return Model(idf, np.zeros((features.DIM, 1), np.float32), np.zeros((0, 3), np.float32), y, prior)
    basis = sparse_svd(x, features.DIM, RANK)
    return Model(idf, basis, unit(np.array([np.append(v @ basis[at], r[3]) for (at, v), r in zip(x, rows)], np.float32)), y, prior)


def classify(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows (id, score, predicted) for every row of docs.

    Null and empty texts get the prior; long texts count whole. Neighbours that
    tie with the K-th vote too. Repeated rows repeat and get equal scores, null
    ids stay null, other columns of docs are ignored; an empty table gives none.
    """
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x RANK and 2 x PER_LABEL x RANK numbers

    def task(batches):
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                s = np.clip(m.score([t or "" for t in part.column(1).to_pylist()]), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(lean(task), f"_id {dict(rows.dtypes)['_id']}, score double, predicted int")
    return out.withColumnRenamed("_id", id_col)


def held_out(id_col="doc_id") -> Column:
    """True for the documents whose labels training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
