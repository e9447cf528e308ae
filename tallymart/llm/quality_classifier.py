"""A quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Training reads at most about ``MOST_ROWS`` labelled texts, chosen by a hash of the
key; that bound is the only one, and scoring covers every text. The training texts
are dealt over ``SHARDS`` tasks, each runs FTRL over its own, and the model is the
mean of their weights: a vector of fixed length, whatever the input. Scoring is a
map over rows: one sparse dot product for each text, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm.ftrl import FTRL, Rates, example, margin, probability
from tallymart.llm.text_features import NGrams

BITS = 18
SHARDS = 4
EPOCHS = 2
MOST_ROWS = 6000
_CHANCES = 1 << 30


@dataclass(frozen=True)
class Model:
    bits: int
    weights: np.ndarray


def training_labels(labels: DataFrame, allowed: Column, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``key, label``: one row for each key that may be learned from, at most about ``MOST_ROWS``.

    Null keys and labels are left out; of several labels of a key the larger counts.
    A key is in by its hash, so the choice does not depend on order or partitions.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy(F.col(key).alias("key"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    share = min(1.0, MOST_ROWS / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("key"), F.lit(_CHANCES)) < int(share * _CHANCES))


def train(texts: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text", rates: Rates = Rates()) -> Model:
    """The model from the texts whose key is among the chosen ``key, label`` rows.

    Without any such text all weights are 0 and every score is 0.5.
    """
    size = 1 << BITS

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows = NGrams(BITS), []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append((*example(grams.of(text), size), label))
        if rows:
            model = FTRL(size, rates)
            for _ in range(EPOCHS):
                for row in rows:
                    model.learn(*row)
            weights = model.weights().astype("<f8").tobytes()
            yield pa.RecordBatch.from_pydict({"weights": [weights], "n": [len(rows)]})

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # the chosen rows are bounded by MOST_ROWS, 16 bytes each
    rows = rows.join(F.broadcast(chosen), "key")
    order = F.xxhash64("key", "text")
    fitted = (
        rows.select("*", F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard"), order.alias("order"))
        .repartitionById(SHARDS, "shard")
        .sortWithinPartitions("order", "key", "text")
        .select("text", "label")
        .mapInArrow(fit, "weights binary, n long")
        .collect()
    )
    parts = sorted((bytes(r["weights"]), r["n"]) for r in fitted)
    weights = np.zeros(size + 1)
    for packed, n in parts:
        weights += np.frombuffer(packed, "<f8") * (n / sum(k for _, k in parts))
    return Model(BITS, weights.astype(np.float32))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score, predicted`` for each row: the probability of label 1, and whether it is 0.5 or more.

    A null or empty text has no n-grams and gets the score of the bias alone. Rows
    are independent: repeated and null keys give a row each. Other columns of the
    input are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.bits, model.weights))  # 4 bytes for each of 2**bits

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, weights = shared.value
        grams = NGrams(bits)
        for batch in batches:
            scores = np.array(
                [probability(margin(weights, grams.of(t))) for t in batch.column(1).to_pylist()], np.float64
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[key, "score", "predicted"],
            )

    fields = [df.schema[key], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return df.select(key, text).mapInArrow(apply, T.StructType(fields))
