"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training has two passes over the labelled texts: one counts in how many texts
of either class each hashed n-gram occurs, one collects the rows of the chosen
features, on which a logistic regression is fitted. Scoring is one pass over
all texts with the weights of the chosen features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.hashing import mix, slices, text_bytes
from tallyframe.session import materialise

SIZES = (4, 5, 6)  # bytes of UTF-8 in an n-gram
BITS = 19  # n-grams are hashed to 2**BITS features
LABEL_ROWS = 20_000  # at most so many labelled rows are used for training, the first in an order of hashed ids
TRAINING_PARTS = 8
FEATURES = 4_096  # the features that tell the classes apart best are kept
FOLDS = 5

_PIECE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Weights of the chosen features; ``slot`` maps a hashed n-gram to its feature or -1."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The hashed n-gram that begins at each byte where one fits."""
    n = len(data) - size + 1
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        packed = (packed << np.uint64(8)) | data[k : k + n]
    return (mix(packed * _FACTOR + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int64)


def _hits(texts: pa.Array, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of all texts, sorted; with ``slot`` only the chosen features.

    An n-gram lies within one text. Long data are walked in overlapping pieces.
    """
    data, offsets = text_bytes(texts)
    data = _FOLD[data]
    span = 1 << BITS if slot is None else len(slot)
    found = []
    for size in SIZES:
        for at in range(0, max(len(data) - size + 1, 0), _PIECE):
            grams = _grams(data[at : at + _PIECE + size - 1], size)
            place = np.arange(at, at + len(grams))
            feature = grams if slot is None else slot[grams]
            if slot is not None:
                keep = np.flatnonzero(feature >= 0)
                place, feature = place[keep], feature[keep]
            row = np.searchsorted(offsets, place, side="right") - 1
            inside = place + size <= offsets[row + 1]
            found.append(np.unique(row[inside] * span + feature[inside]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // span, keys % span


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class a feature occurs; one sparse block for each task."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(bool)
            row, feature = _hits(part.column("text"), None)
            for kind in (0, 1):
                counts[kind] += np.bincount(feature[label[row] == bool(kind)], minlength=1 << BITS)
    seen = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], names=["feature", "clean", "toxic"]
    )


def _training_rows(slot: np.ndarray) -> Callable:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = _hits(part.column("text"), slot)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "features"]
                )

    return collect


def _fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on features scaled by ``ratio``, by accelerated gradients."""
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    feature = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    value = ratio[feature]
    # Each class weighs half.
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    norm = np.bincount(row, value**2, len(rows))
    rate = 1.0 / (0.25 * float((weight * (norm + 1)).sum()) + 1e-3)
    w, b, w0, b0 = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio)), 0.0
    for step in range(steps):
        pull = step / (step + 3)
        v, c = w + pull * (w - w0), b + pull * (b - b0)
        z = np.bincount(row, value * v[feature], len(rows)) + c
        miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.bincount(feature, miss[row] * value, len(ratio)) + 1e-4 * v
        w0, b0 = w, b
        w, b = v - rate * slope, c - rate * miss.sum()
    return w * ratio, float(b)


def held_out(doc_id):
    """Rows of the fold that is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, features: int = FEATURES) -> Model:
    """Fit on at most ``label_rows`` labelled rows outside the held-out fold.

    Several labels of one document count by their maximum; null labels and ids
    and labels without a document do not count. Without rows of both classes
    every text gets the score 0.
    """
    empty = Model(np.full(1 << BITS, -1, np.int32), np.zeros(1), -30.0)
    chosen = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    )
    # At most label_rows short rows: the bound makes the broadcast safe.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    texts = materialise(texts.repartition(TRAINING_PARTS), "toxicity-training")
    counts = (
        texts.select("text", "label").mapInArrow(_counter, "feature bigint, clean bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    # Both totals are at most label_rows, and there are 2**BITS features at most.
    totals = texts.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    if not n.get(0) or not n.get(1):
        return empty
    rate_toxic = (F.col("toxic") + 1) / (n[1] + 2)
    rate_clean = (F.col("clean") + 1) / (n[0] + 2)
    ratio = F.log(rate_toxic / rate_clean)
    # Likelihood gain of knowing the feature, by class halves.
    gain = (rate_toxic - rate_clean) * ratio
    best = (
        counts.select("feature", ratio.alias("ratio"), gain.alias("gain"))
        .orderBy(F.col("gain").desc(), "feature").limit(features).collect()
    )
    slot = np.full(1 << BITS, -1, np.int32)
    slot[[r["feature"] for r in best]] = np.arange(len(best))
    ratios = np.array([r["ratio"] for r in best])
    rows = texts.mapInArrow(_training_rows(slot), "doc_id bigint, label int, features array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["features"]))
    weights, bias = _fit(
        [np.array(r["features"], dtype=np.int64) for r in rows], np.array([r["label"] for r in rows]), ratios
    )
    return Model(slot, weights, bias)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    row, feature = _hits(texts, model.slot)
    z = np.bincount(row, model.weights[feature], len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score and class of every row of ``docs`` (doc_id, text); a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**BITS slots and FEATURES weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = score_texts(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(values)], names=["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id bigint, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) and score every row of ``docs`` (doc_id, text).

    The score depends on the text alone. Repeated rows are scored each, a null
    doc_id stays null and is not held out, other columns are not read, and no
    rows give no rows.
    """
    return score(docs, train(docs, labels))
