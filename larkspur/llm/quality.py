"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed character trigrams of the whole text (case and punctuation kept)
and repeats of the word before, weighted by tf-idf with document frequencies of all
documents. The singular vectors of a bounded sample of labelled documents span the
latent space. The labelled vectors are broadcast; every document's exact cosine to
each of them is computed in blocks, and the nearest ones vote by similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import held_out, labelled, mapped

TERMS = 4096
#: Labelled documents that the space and the votes are fitted on, at most, per class.
PER_CLASS = 1500
#: Places that a repeat of the word before counts in, lest the many trigrams drown it.
REPEATS = 64
LATENT = 64
NEIGHBOURS = 15
BLOCK = 512


def counts(text: str | None, terms: int = TERMS) -> np.ndarray:
    """How often each hashed term occurs in the whole text."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(terms, np.float32)
    step = 1 << 20
    for lo in range(0, max(len(raw) - 2, 0), step):
        b = np.frombuffer(raw, np.uint8, min(step + 2, len(raw) - lo), lo).astype(np.uint32)
        code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - (terms - 1).bit_length()), minlength=terms)
    words = raw.split()
    out[:: terms // REPEATS] += sum(map(bytes.__eq__, words[1:], words[:-1]))
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    k: int = NEIGHBOURS

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = weighted(rows, self.idf) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes of the nearest labelled vectors; the prior where nothing is near."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        sims = (self.latent(rows) @ self.vectors.T).astype(np.float64)
        k = min(self.k, len(self.labels))
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(sims, near, 1), 0) ** 4 * self.weights[near]
        total = vote.sum(1)
        return np.where(total > 1e-12, (vote * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)


def weighted(rows: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unit rows of damped counts times idf, written into out if given (rows itself may be), so that no second copy is held."""
    x = np.log1p(rows, out=out)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-12)
    return x


def document_frequencies(docs: DataFrame, text: str = "text", terms: int = TERMS) -> tuple[int, np.ndarray]:
    """Number of documents and in how many of them each term occurs, over all documents.

    A task hands on one dense vector of fixed length; they are added up by position.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(terms, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                n += 1
                df += counts(t, terms) > 0
        yield pd.DataFrame({"term": np.arange(-1, terms), "n": np.concatenate([[n], df])})

    rows = docs.select(F.col(text).alias("t")).mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(terms, np.int64)
    for r in rows:
        if r.term >= 0:
            df[r.term] = r.n
    return next((r.n for r in rows if r.term < 0), 0), df


def _sparse(texts: list[str]) -> list:
    found = [counts(t) for t in texts]
    at = [np.flatnonzero(c) for c in found]
    return [[a.astype(np.int32) for a in at], [c[a] for c, a in zip(found, at)]]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, latent: int = LATENT, seed: int = 7) -> Model:
    """Term weights from all documents; space and voters from at most per_class labelled rows of each class (see labelled()).

    The driver gets at most 2 * per_class vectors of at most TERMS counts. Without any usable label every text
    gets 0.5, with labels of one class only that class's share of 1 (0 or 1).
    """
    n, df = document_frequencies(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    rows, sizes = labelled(docs, labels, label, per_class, key, text)
    # Tasks count the terms; the driver gets what the sample's texts count, as Arrow, not the texts.
    found = mapped(rows, ["t"], "at array<int>, n array<float>", _sparse, keep=False).select("k", "y", "at", "n").toArrow().sort_by([("y", "ascending"), ("k", "ascending")])
    y = found.column("y").to_numpy().astype(np.float64)
    raw = np.zeros((len(y), TERMS), np.float32)
    at, n_at = (found.column(c).combine_chunks() for c in ("at", "n"))
    raw[np.repeat(np.arange(len(y)), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy()] = n_at.flatten().to_numpy()
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if not len(y):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    del found, at, n_at
    x = weighted(raw, idf, out=raw)
    # Randomised range finder with two power steps; its own size is fixed by terms and sample bound.
    q = x.T @ np.random.default_rng(seed).standard_normal((len(x), min(latent + 16, len(x)))).astype(np.float32)
    for _ in range(2):
        q = x.T @ (x @ np.linalg.qr(q)[0])
    q = np.linalg.qr(q)[0]
    basis = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :latent].astype(np.float32)
    # A vote stands for all labelled documents of its class that the sample left out.
    picked = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    model = Model(idf, basis, np.zeros((0, 1), np.float32), y, np.array([sizes[int(v)] / picked[int(v)] for v in y]), prior)
    z = x @ basis
    model.vectors = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with ``score``, 0 to 1, higher where label 1 is likelier.

    Null and empty texts have no terms and get the prior; rows stay one for one. A column
    of docs that is named as the score comes out with ``_in`` appended.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if clash := [c for c in docs.columns if c.lower() == out.lower()]:
        docs = docs.withColumnRenamed(clash[0], f"{clash[0]}_in")

    def make(texts: list[str | None]) -> list:
        m: Model = shared.value
        made = [m.score(np.stack([counts(t, len(m.idf)) for t in texts[lo : lo + BLOCK]])) for lo in range(0, len(texts), BLOCK)]
        return [np.concatenate(made) if made else np.zeros(0)]

    return mapped(docs, [text], f"{out} double", make)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, scorer: Callable = score, fitter: Callable = fit) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    scored = scorer(docs.select("doc_id", "text"), fitter(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
