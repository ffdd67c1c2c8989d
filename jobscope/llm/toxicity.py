"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes the labelled rows outside the held-out fold; of these at most ``max_train`` (those of
lowest hash, a documented bound of the fit alone). Spark counts in how many texts of either class
each hashed n-gram is present, keeps the ``selected`` n-grams whose log-count ratio is most certain
(the same number whatever the input's size; on held-out rows this does better than all n-grams, see
the README), and gathers the kept n-grams of the bounded sample, over which a logistic regression on
presence times ratio is fitted with numpy. Scoring is a per-row map over every whole text.

Cases: a null or empty text has no n-gram and gets the score of the intercept; null labels are not
learned from; rows that repeat a ``doc_id`` in the labels count as toxic if one of them says so;
with one class only, every score is the smoothed share of that class; a null ``doc_id`` is never
held out. Labels, language, source and id are no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import per_slice, text_of

BUCKET_BITS = 18
ORDERS = (3, 4, 5)
MAX_TRAIN, SELECTED, ROUNDS, RIDGE = 20_000, 2048, 150, 1e-4

#: Characters hashed at once, so that a very long text needs bounded memory.
STRIDE = 1 << 20


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the text's lower-cased character n-grams, with a space at either end."""
    letters = np.frombuffer(f" {text.lower().replace(chr(10), ' ')} ".encode("utf-32-le", "replace"), "<u4")
    for at in range(0, len(letters), STRIDE):
        c = letters[at : at + STRIDE + ORDERS[-1] - 1]
        h = c.copy()
        for n in range(2, ORDERS[-1] + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if n in ORDERS:
                own = h[:STRIDE] * np.uint32(0x9E3779B1)
                yield ((own ^ own >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(32 - BUCKET_BITS)


def _present(text: str) -> np.ndarray:
    found = [np.unique(b) for b in gram_buckets(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    """Where each bucket's weight is (-1: none), the weights, and the intercept."""

    place: np.ndarray
    weights: np.ndarray
    intercept: float

    def kept(self, text: str) -> np.ndarray:
        """Places of the kept n-grams that the text has."""
        found = []
        for buckets in gram_buckets(text):
            at = self.place[buckets]
            found.append(at[at >= 0])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)

    def score(self, text: str) -> float:
        """Between 0 and 1; higher: toxic is likelier."""
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.kept(text)].sum(), -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``text`` and ``toxic`` of the bounded sample of labelled rows outside the held-out fold."""
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return text_of(docs).join(F.broadcast(sample), "doc_id").select("text", "toxic")  # bounded by max_train rows


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, selected: int = SELECTED) -> ToxicityModel:
    """Fit the classifier; see the module for what is counted and what is sampled."""
    rows = training_rows(docs, labels, max_train)
    buckets = 1 << BUCKET_BITS

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, buckets), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                seen[int(toxic > 0), _present(text.as_py())] += 1
                texts[int(toxic > 0)] += 1
        if texts.any():
            at = np.flatnonzero(seen.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[0, at], texts[0])), pa.array(np.append(seen[1, at], texts[1]))], ["bucket", "clean", "toxic"])

    by_bucket = rows.mapInArrow(counts, "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most 2 ** BUCKET_BITS + 1 rows, however large the input
    table = by_bucket.toPandas().sort_values("bucket", ignore_index=True)
    place = np.full(buckets, -1, np.int32)
    texts = table[table["bucket"] < 0]
    n0, n1 = (int(texts["clean"].sum()), int(texts["toxic"].sum()))
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return ToxicityModel(place, np.zeros(0), prior)
    table = table[table["bucket"] >= 0]
    q, p = table["clean"].to_numpy() + 1.0, table["toxic"].to_numpy() + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    certain = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    best = np.argsort(-certain, kind="stable")[:selected]
    place[table["bucket"].to_numpy()[best]] = np.arange(len(best))
    scale = ratio[best]
    model = ToxicityModel(place, scale, prior)

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [model.kept(t).astype("<i4").tobytes() for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), batch["toxic"]], ["kept", "toxic"])

    # at most max_train rows of at most ``selected`` small integers
    sample = rows.mapInArrow(per_slice(gather), "kept binary, toxic int").toPandas()
    return ToxicityModel(place, *fit(sample["kept"].tolist(), (sample["toxic"].to_numpy() > 0).astype(float), scale, prior))


def fit(kept: list[bytes], y: np.ndarray, scale: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights (scale included) and intercept of a ridge logistic regression, by accelerated gradient steps."""
    order = sorted(range(len(kept)), key=lambda i: (kept[i], y[i]))  # rows come in any order; sums shouldn't depend on it
    kept, y = [kept[i] for i in order], y[order]
    at = np.frombuffer(b"".join(kept), "<i4").astype(np.int64)
    row = np.repeat(np.arange(len(kept)), [len(k) // 4 for k in kept])
    w, b = np.zeros(len(scale)), prior
    m1, m2, n = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1), len(y)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(row, weights=(w * scale)[at], minlength=n)
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.append(np.bincount(at, weights=miss[row], minlength=len(scale)) * scale + RIDGE * w, miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w * scale, float(b)


def score_table(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score of at least ``threshold``) of every whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(t) for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    scored = text_of(docs).mapInArrow(per_slice(work), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores under the threshold."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda t: model.score(t or "")).astype("float64")

    return docs.where(score(docs["text"]) < threshold)
