"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that it holds, once each. For every bucket the
smoothed shares of toxic and of other labelled texts that hold it give a log ratio. The FEATURES
buckets whose shares differ most, in standard errors, are kept, and a logistic regression is fitted
on them, each scaled by its log ratio. Labels are read for the fit only.

The fit uses at most FIT_ROWS labelled rows, those with the smallest hash of doc_id. Their bucket
counts are summed by Spark; the driver receives these sums (2^BITS numbers a class) and at most
FEATURES kept buckets a row, so what it holds is bounded. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoaffinity.llm.frames import batch_of, checkpointed, columns_of, crc_fold

#: Labelled rows that the fit reads at most.
FIT_ROWS = 6000
BITS = 20
ORDERS = (3, 4, 5, 6)
FEATURES = 2000
#: Characters hashed at once; longer texts are hashed in overlapping pieces.
PIECE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FIT_TASKS = 8
_BLOCK = 1 << 14

_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
)


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, in parts. Case and kind of white space don't count."""
    text = " " + " ".join((text or "").lower().split()) + " "
    overlap = max(ORDERS) - 1
    for start in range(0, max(1, len(text) - overlap), PIECE):
        piece = text[start : start + PIECE + overlap]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        hashed = codes
        for order in range(2, max(ORDERS) + 1):
            hashed = hashed[: max(0, len(codes) - order + 1)] * _MULTIPLIER + codes[order - 1 :]
            if order in ORDERS:
                mixed = (hashed ^ (hashed >> np.uint64(29))) * _MULTIPLIER
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def kept_buckets(text: str | None, kept: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text among the kept ones (a flag for each bucket), ascending."""
    return np.unique(np.concatenate([part[kept[part]] for part in ngram_buckets(text)]))


@dataclass(frozen=True)
class ToxicityModel:
    """kept: ascending buckets. weights: theirs, log ratio included. bias: the score of none."""

    kept: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        margin = self.bias + float(self.weights[np.searchsorted(self.kept, found)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def select_features(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept buckets and the log ratios of all; toxic, other: texts that hold each bucket."""
    p, q = (toxic + 0.5) / (n_toxic + 1), (other + 0.5) / (n_other + 1)
    both = (toxic + other + 1) / (n_toxic + n_other + 2)
    apart = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / max(1, n_toxic) + 1 / max(1, n_other)))
    kept = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    ratio = np.log((toxic + 1) / (toxic + 1).sum()) - np.log((other + 1) / (other + 1).sum())
    return kept, ratio


def fit_weights(
    rows: list[np.ndarray], labels: list[int], ratio: np.ndarray, passes: int = 15, rate: float = 0.1, decay: float = 0.01
) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of places in ratio, by adaptive gradient steps in row order."""
    weight, squares = np.zeros(len(ratio)), np.full(len(ratio), 1e-6)
    bias, bias_squares = -2.0, 1e-6
    for _ in range(passes):
        for found, label in zip(rows, labels, strict=True):
            x = ratio[found]
            margin = bias + float(weight[found] @ x)
            error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
            gradient = error * x + decay * weight[found]
            squares[found] += np.square(gradient)
            weight[found] -= rate * gradient / np.sqrt(squares[found])
            bias_squares += error * error
            bias -= rate * error / np.sqrt(bias_squares)
    return weight * ratio, float(bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most fit_rows labelled rows outside the held-out fold."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold() != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # the ids are bounded by fit_rows, so they may be broadcast; repeated rows are bounded by the limit
    return (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(fit_rows)
    )


def class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For toxic and other texts of a sample: how many hold each bucket."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.uint16)
        seen = np.zeros(1 << BITS, bool)
        for _, texts, toxic in columns_of(batches):
            for text, label in zip(texts, toxic, strict=True):
                for part in ngram_buckets(text):
                    seen[part] = True
                found = np.flatnonzero(seen)
                counts[label, found] += 1
                seen[found] = False
        blocks = range(0, 1 << BITS, _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([label for label in (0, 1) for _ in blocks], pa.int32()),
                pa.array([at for _ in (0, 1) for at in blocks], pa.int32()),
                pa.array([counts[label, at : at + _BLOCK].tobytes() for label in (0, 1) for at in blocks], pa.binary()),
            ],
            names=["toxic", "block", "counts"],
        )

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, np.uint16).astype(np.int64) for c in rows["counts"])
        return pd.DataFrame({"toxic": [key[0]], "block": [key[1]], "counts": [counts.astype(np.uint16).tobytes()]})

    schema = "toxic int, block int, counts binary"
    summed = np.zeros((2, 1 << BITS))
    rows = sample.mapInArrow(partial, schema).groupBy("toxic", "block").applyInPandas(total, schema).collect()
    for label, at, counts in rows:
        summed[label, at : at + _BLOCK] = np.frombuffer(counts, np.uint16)
    return summed[1], summed[0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on labelled rows. A doc_id with several labels counts as toxic if one says so.

    At most 65,535 rows can be counted. Without texts of both kinds the model is flat.
    """
    if not 0 < fit_rows < 1 << 16:
        raise ValueError("fit_rows must be from 1 to 65535")
    sample = checkpointed(labelled_sample(docs, labels, fit_rows).repartition(_FIT_TASKS, "doc_id"))
    seen = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = seen.get(1, 0), seen.get(0, 0)
    if not n_toxic or not n_other:
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return ToxicityModel(np.zeros(1, np.int64), np.zeros(1), float(np.log(share / (1 - share))))
    kept, ratio = select_features(*class_counts(sample), n_toxic, n_other)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        flags[kept] = True
        for ids, texts, toxic in columns_of(batches):
            places = [np.searchsorted(kept, kept_buckets(text, flags)).astype(np.int32).tobytes() for text in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(places, pa.binary())],
                names=["doc_id", "toxic", "places"],
            )

    rows = sorted(
        sample.mapInArrow(features, "doc_id long, toxic int, places binary")
        .withColumn("nth", F.xxhash64("doc_id"))
        .select("nth", "doc_id", "places", "toxic")
        .collect()
    )
    weights, bias = fit_weights(
        [np.frombuffer(row["places"], np.int32) for row in rows], [row["toxic"] for row in rows], ratio[kept]
    )
    return ToxicityModel(kept, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): held_out, score, predicted.

    labels: (doc_id, toxic). Null texts count as empty and get the score of no feature. A null
    doc_id stays null and hashes as an empty string; repeated rows are scored each. Without labels
    of both kinds every row gets the same score. Other columns are not read; an empty table gives
    an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, fit_rows))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        flags[model.value.kept] = True
        for ids, texts, held_out in columns_of(batches):
            scores = [model.value.score(kept_buckets(text, flags)) for text in texts]
            yield batch_of(_ARROW, [ids, held_out, scores, [int(s >= 0.5) for s in scores]])

    return docs.select(
        docs["doc_id"].cast("long"), docs["text"].cast("string"), (crc_fold() == 0).alias("held_out")
    ).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, fit_rows))

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        flags = np.zeros(1 << BITS, bool)
        flags[model.value.kept] = True
        return pd.Series([model.value.score(kept_buckets(text, flags)) >= 0.5 for text in texts])

    return docs.filter(~toxic(docs["text"].cast("string")))
