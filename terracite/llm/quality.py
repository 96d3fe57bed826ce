"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.llm import features
from terracite.session import pick

#: Columns of raw trigrams, of trigrams of shapes, and of words that only repeat the word before (by share, see STEPS).
WIDTHS = (4096, 1024, 5)
STEPS = (0.0, 0.03, 0.1, 0.3)
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed trigram counts of the texts as they stand and of their shapes, and the class of their repeated words."""
    raw, owner = features.joined(texts)
    echo = np.zeros((len(texts), WIDTHS[2]), dtype=np.float32)
    for i, text in enumerate(texts):
        words = (text or "").split()
        share = sum(map(eq, words, words[1:])) / max(1, len(words))
        echo[i, np.searchsorted(STEPS, share)] = 1
    return np.hstack([features.trigrams(raw, owner, len(texts), WIDTHS[0]), features.trigrams(features.SHAPE[raw], owner, len(texts), WIDTHS[1]), echo])


class Neighbours:
    """Labelled vectors in a latent space of tf-idf trigrams, and the vote of the nearest."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int, nearest: int):
        n = len(x)
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        self.basis = np.eye(1, dtype=np.float32)
        weighed = self.weigh(x)
        self.basis = self.latent(weighed, min(rank, n))
        self.points = features.unit(weighed @ self.basis).astype(np.float32)
        self.labels, self.prior, self.nearest = labels.astype(np.float32), float(labels.mean()), min(nearest, n)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        out, start = np.log1p(x), 0
        out *= self.idf
        for width in WIDTHS:  # in place: each kind of column gets length 1
            part = out[:, start : start + width]
            part /= np.maximum(np.sqrt(np.einsum("ij,ij->i", part, part)), 1e-12)[:, None]
            start += width
        return out

    @staticmethod
    def latent(x: np.ndarray, rank: int) -> np.ndarray:
        """Right singular vectors of x by randomised subspace iteration."""
        q = x.T @ np.random.default_rng(0).standard_normal((len(x), rank + 8)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        return (q @ vt.T)[:, :rank].astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted mean label of the nearest points; the prior where nothing is similar."""
        near = features.unit(self.weigh(x) @ self.basis) @ self.points.T
        top = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 2
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-12), self.prior)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 3000, rank: int = 48, nearest: int = 11, folds: int = 5, out: int = 0) -> Neighbours | None:
    """Labelled vectors from a bounded sample: about ``most_rows`` labels by a hash of doc_id, outside the held-out fold.

    A document with several labels has their mean. The sampled labels are few, so they go to the documents. Of rows that
    repeat a doc_id each distinct text counts once; if those are over twice ``most_rows``, a hash chooses among them.
    """
    usable = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != out))
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = most_rows / max(1, usable.count())
    chosen = usable.where(chance < share).groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(chance, "doc_id").limit(2 * most_rows)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = list(frame["text"])
            for a, b in features.blocks(texts):
                x = counts(texts[a:b]).astype(np.uint32)
                yield frame[["doc_id", "text_hash", "label"]].iloc[a:b].assign(x=[zlib.compress(v.tobytes(), 1) for v in x])

    named = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # 2 * most_rows rows at most
    texts = named.select("doc_id", F.xxhash64("text").alias("text_hash"), "label", "text")
    rows = (
        features.sampled(texts, 2 * most_rows, "doc_id", "text_hash")
        .mapInPandas(count, "doc_id long, text_hash long, label double, x binary")
        .groupBy("doc_id", "text_hash")
        .agg(F.min("label").alias("label"), F.min("x").alias("x"))
        .collect()
    )
    rows = sorted((bytes(r["x"]), r["label"]) for r in rows)
    if not rows:
        return None
    marks = np.array([v for _, v in rows])
    x = np.empty((len(rows), sum(WIDTHS)), dtype=np.float32)
    for k in range(len(rows)):
        x[k] = np.frombuffer(zlib.decompress(rows[k][0]), dtype=np.uint32)
        rows[k] = None  # one copy at a time
    return Neighbours(x, marks, rank, nearest)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, out: int = 0, **limits: int) -> DataFrame:
    """Quality of every whole text, as ``labels.quality`` marks it, by the vote of its nearest labelled documents.

    Texts are hashed trigram counts, weighed by tf-idf and projected to a latent space; the labelled vectors (a bounded
    sample, see ``fit``) are sent to every task, and each block of documents takes its exact cosines with all of them.
    The nearest ones vote with the square of their similarity. Labels, languages, sources and ids are never inputs of
    a score, and labels of the held-out fold are never learned from.

    Null and empty texts are similar to nothing much and are scored like any other. Without a usable label every score
    is 0.5. A null doc_id is in no fold: held_out is false. Repeated rows get the same score. Empty table: no rows.
    Other columns are ignored.

    Returns doc_id, held_out, score, predicted (1 from ``threshold`` up).
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs, pick(labels, "doc_id", "quality"), folds=folds, out=out, **limits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in frames:
            texts = list(frame["text"])
            for a, b in features.blocks(texts):
                score = np.full(b - a, 0.5) if known is None else known.score(counts(texts[a:b])).astype(float)
                score = np.clip(score, 0, 1)
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "held_out": frame["held_out"].iloc[a:b], "score": score, "predicted": (score >= threshold).astype("int32")}).astype({"doc_id": "Int64"})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInPandas(run, SCORED)


def keep_good(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], threshold: float = 0.3, **limits: int) -> DataFrame:
    """The columns of the documents that score ``threshold`` or more; without a usable label all documents."""
    docs = pick(docs, *columns)
    model = fit(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), pick(labels, "doc_id", "quality"), **limits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in features.blocks(texts):
                good = np.ones(b - a, dtype=bool) if sent.value is None else sent.value.score(counts(texts[a:b])) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
