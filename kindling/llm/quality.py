"""Quality: nearest-neighbour voting among labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.common import blocks, in_fold, labelled_sample, span_hashes, word_spans

#: Labelled documents of each class that vote at most, and their characters; chosen by a hash of the id.
TRAIN_DOCS, TRAIN_CHARS = 1000, 5_000_000
#: Hashed terms, dimensions of the latent space, neighbours that vote.
TERMS, DIMENSIONS, NEIGHBOURS = 4096, 48, 25
#: Weight of repeated words against all other terms together.
REPETITION = 2.0
#: Score from which a document counts as good.
THRESHOLD = 0.3


def term_counts(texts: list[str]) -> np.ndarray:
    """(texts, TERMS) counts of hashed runs of three bytes, as written, over whole texts."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 3 for p in parts])
    data = np.frombuffer(b"".join(b" " + p + b" \0" for p in parts), dtype=np.uint8).astype(np.uint32)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(TERMS).bit_length() + 1)
    slot = slot.astype(np.int64) + np.repeat(np.arange(len(parts)) * TERMS, sizes)[:-2]
    inside = np.ones(len(slot), dtype=bool)
    for back in (1, 2):  # runs that reach over the end of a text
        at = np.cumsum(sizes) - back
        inside[at[at < len(slot)]] = False
    return np.bincount(slot[inside], minlength=len(parts) * TERMS).reshape(len(parts), TERMS)


def repetition(texts: list[str]) -> np.ndarray:
    """Share of a text's words that are the word before them again, in any ASCII case."""
    data, starts, ends, first, _ = word_spans([t.encode("utf-8", "surrogatepass").lower() for t in texts])
    words = span_hashes(data, starts, ends)
    same = np.zeros(len(words) + 1)
    np.cumsum(np.concatenate([[False], words[1:] == words[:-1]])[: len(words)], out=same[1:])
    n = np.diff(first)
    return np.where(n > 1, (same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]) / np.maximum(n - 1, 1), 0.0)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents that hold each term, documents), over all rows; each task sends one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                df += (term_counts(texts) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[n], df]))], names=["term", "df"])

    rows = docs.select(F.col(text).cast("string").alias("body")).mapInArrow(run, "term long, df long")
    found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return np.array([found.get(t, 0) for t in range(TERMS)], dtype=float), int(found.get(-1, 0))


@dataclass
class Model:
    """Term weights, the latent basis, and the labelled vectors with their votes."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of log counts times idf, and repetition as one more term."""
        x = np.log1p(term_counts(texts)) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.concatenate([x, REPETITION * np.sqrt(repetition(texts))[:, None]], axis=1)

    def latent(self, texts: list[str]) -> np.ndarray:
        z = self.weighted(texts) @ self.basis
        return (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score(self, texts: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the votes of the nearest labelled vectors, each weighted by the eighth power
        of its cosine; a text without terms, or no labelled vectors: the share of label 1."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(neighbours, len(self.vectors))
        for i in range(0, len(texts), 256):
            cosine = self.latent(texts[i : i + 256]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            sim = np.take_along_axis(cosine, near, axis=1).astype(float)
            weight = np.maximum(sim, 0.0) ** 8 + 1e-9
            out[i : i + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        blank = [i for i, t in enumerate(texts) if not t.strip()]
        out[blank] = self.prior
        return out


def fit(texts: list[str], labels: np.ndarray, df: np.ndarray, n: int, shares: tuple[float, float], dimensions: int = DIMENSIONS) -> Model:
    """The latent space of the labelled texts: the leading right singular vectors of their weighted term counts."""
    model = Model(np.log((n + 1) / (df + 1)) + 0.1, np.zeros((TERMS + 1, 0)), np.zeros((0, 0), dtype=np.float32), labels.astype(float), shares[1])
    if not len(texts):
        return model
    x = np.concatenate([model.weighted(texts[i : i + 200]).astype(np.float32) for i in range(0, len(texts), 200)])
    values, left = np.linalg.eigh((x @ x.T).astype(float))
    lead = np.argsort(-values)[: min(dimensions, len(texts))]
    lead = lead[values[lead] > 1e-9]
    model.basis = x.T @ (left[:, lead] / np.sqrt(values[lead]))
    model.vectors = np.concatenate([model.latent(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Term statistics over all of ``docs``; the space and the votes from at most ``train_docs`` labelled
    documents of each class (TRAIN_CHARS characters) that are not held out."""
    df, n = document_frequencies(docs, text)
    texts, ys, shares = labelled_sample(docs, labels, ~in_fold("id", 5, 0), key, text, label, train_docs, TRAIN_CHARS)
    return fit(texts, ys, df, n, shares)


def _scorer(sent: Broadcast):
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            scores = [sent.value.score(texts) for _, texts in blocks(array)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return run


def score_quality(docs: DataFrame, model: Model, text: str = "text", column: str = "quality") -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier, from the whole text.

    Null, empty and blank texts get the share of label 1 among the labels (0 without labels). Repeated rows
    score alike; an empty table gives no rows; a column named as ``column`` is replaced. Documents do not
    move between tasks; what tasks are sent is bounded by the sample: its vectors, the basis and the term weights.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(column, F.arrow_udf(_scorer(sent), "double").asNondeterministic()(F.col(text).cast("string")))
