"""What the two label-trained scores share: a bounded training sample, the fit and the scoring pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, documents, fold, map_rows, map_texts, steps
from .linear import Model, fit

#: Labelled rows that a classifier is fitted on, at most about.
TRAIN_ROWS = 6000
SCHEMA = "doc_id long, score double, predicted int"


def train(docs: DataFrame, labels: DataFrame, label: str, features: Callable, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``rows`` labelled documents.

    ``features()`` is called once a task and returns a function from texts to distinct buckets.  A
    doc_id with several labels takes the largest; NULL ids and labels are left out.  The sampled
    labels are few by construction and meet the documents in a broadcast join, so no text moves.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    some = bounded(known.groupBy("doc_id").agg(F.max("y").alias("y")), rows, "train")
    joined = documents(docs).join(F.broadcast(some), "doc_id").select("y", "text")

    def work(batches) -> Iterator[dict]:
        f = features()
        for batch in batches:
            for ys, texts in steps(batch.column(0), batch.column(1)):
                yield {"y": ys, "ids": [x.astype(np.int32).tobytes() for x in f(texts)]}

    got = sorted((row.ids, row.y) for row in map_rows(joined, work, "y int, ids binary").collect())
    return fit([np.frombuffer(ids, np.int32) for ids, _ in got], [int(y > 0) for _, y in got])


def score(docs: DataFrame, model: Model, features: Callable) -> DataFrame:
    """doc_id, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one float32 pair a bucket: 2 MB whatever the corpus

    def work():
        f, held = features(), sent.value

        def columns(ids: list, texts: list) -> dict:
            found = held.score(f(texts))
            return {"doc_id": ids, "score": found, "predicted": (found >= 0.5).astype(np.int32)}

        return columns

    return map_texts(docs, work, SCHEMA)


def query(docs: DataFrame, labels: DataFrame, label: str, features: Callable, folds: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted: trained on rows outside the held-out fold only."""
    model = train(docs, labels.where(fold("doc_id", folds) != held_out), label, features)
    return score(docs, model, features).select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", "predicted")
