"""Quality classifier by compression: dictionaries of good and bad texts, their compressed sizes, a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import bounded_batches

#: Each class gives at most so many labelled texts, and stops after so many bytes; DICTIONARY_TEXTS of them train its dictionary.
SAMPLE_TEXTS, SAMPLE_BYTES, DICTIONARY_TEXTS = 5_000, 64 << 20, 2_000
DICTIONARY_BYTES, LEVEL = 112_640, 3
#: Bytes that are compressed at a time.
BLOCK_BYTES = 1024


@dataclass
class CompressionModel:
    """Two dictionaries (None where a class has too little text) and the weights of the calibration."""

    good: bytes | None
    bad: bytes | None
    weights: list[float]
    mean: list[float]
    scale: list[float]


def _compressors(model: CompressionModel) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw) if raw else None
        if d:
            d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
    return out


def _features(texts: Iterator[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """The normalised difference of compressed sizes, the compressed size a byte, its square and the product of both.

    A text is compressed whole, block by block, each against the dictionaries alone: so the difference does not fade, and no text's score depends on its length.
    """
    rows = []
    for t in texts:
        g = b = 0
        for at in range(0, max(1, len(t)), BLOCK_BYTES):
            block = t[at : at + BLOCK_BYTES]
            g, b = g + len(good.compress(block)), b + len(bad.compress(block))
        rows.append((g, b, len(t) + 1))
    g, b, n = np.array(rows, float).reshape(-1, 3).T
    difference, rate = (b - g) / np.maximum(b + g, 1), np.minimum(g, b) / n
    return np.column_stack([difference, rate, rate * rate, difference * rate])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on a bounded sample; a step that does not lower the loss is halved."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        last, now = now, loss(w)
        if last - now < 1e-9:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        joined = b"\n".join(texts)[-DICTIONARY_BYTES:]
        return joined if len(joined) >= 8 else None


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    """Fit on docs (doc_id, text) and labels (doc_id, label: 1 good, 0 bad; one row for each document, others left out).

    Only a bounded sample reaches the driver: of each class the SAMPLE_TEXTS labelled documents with the smallest hashed id, whole,
    until SAMPLE_BYTES are reached. The ids are chosen from the labels alone, so that only the sampled texts move. Texts that train
    a dictionary do not calibrate. With one class or none, every text gets that class's share (0.5 without any label).
    """
    picked: dict[int, list[bytes]] = {}
    for value in (1, 0):
        # SAMPLE_TEXTS rows of two numbers at most: small enough to broadcast whatever the size of the corpus
        ids = labels.where(F.col("label") == value).select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("_h")).orderBy("_h", "_id").limit(SAMPLE_TEXTS)
        rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "_h").orderBy("_h", F.crc32("text")).limit(SAMPLE_TEXTS)
        picked[value], size = [], 0
        for r in rows.toLocalIterator():
            if size < SAMPLE_BYTES:
                picked[value].append(r[0].encode())
                size += len(picked[value][-1])
    good, bad = picked[1], picked[0]
    if not good or not bad:
        prior = 0.5 if not good and not bad else float(bool(good))
        return CompressionModel(None, None, [8 * (2 * prior - 1)] + [0.0] * 4, [0.0] * 4, [1.0] * 4)
    dictionaries, rest = [], []
    for texts in (good, bad):
        n = min(DICTIONARY_TEXTS, (len(texts) + 1) // 2)
        dictionaries.append(_dictionary(texts[:n]))
        rest.append(texts[n:] or texts)
    model = CompressionModel(*dictionaries, [], [], [])
    x = np.vstack([_features(iter(t), *_compressors(model)) for t in rest])
    y = np.concatenate([np.ones(len(rest[0])), np.zeros(len(rest[1]))])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    model.weights, model.mean, model.scale = _newton((x - mean) / scale, y).tolist(), mean.tolist(), scale.tolist()
    return model


def score(text: Column, model: CompressionModel) -> Column:
    """Probability, 0 to 1, that a text is of the good kind. Null counts as empty; the empty text has a score too."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressors(model)
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for texts in batches:
            x = (_features((t.encode() for t in texts), good, bad) - mean) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return scored(F.coalesce(text, F.lit("")))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0))


def classify(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3, threshold: float = 0.5) -> DataFrame:
    """All columns of docs with held_out, score and predicted; fitted on labelled rows outside the held-out fold.

    A document with contradicting labels counts as bad; labels of unknown documents and null labels are left out.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("label"))
    model = fit(docs.select("doc_id", "text"), known.select(F.col("_id").alias("doc_id"), "label").where(fold(F.col("_id"), folds) != held))
    return (
        bounded_batches(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
        .withColumn("score", score(F.col("text"), model))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learned outside the fold crc32 mod 3 = 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
