"""Toxicity: a subword-bag classifier fitted on a bounded labelled sample and applied to every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import materialize, slices
from .subword_model import SubwordModel, train

#: Labelled documents of each label that a fit reads at most.
SAMPLE_PER_LABEL = 2_500
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_LABEL) -> SubwordModel:
    """Trains in one task on at most `most` documents of each label outside the held-out fold (see labelled.within)."""
    chosen = labelled.sample(docs, labels, "toxic", most, by_label=True).select("text", "y", "order")
    rows = materialize(labelled.within(chosen, 2 * most), "toxicity-sample")  # ids may repeat

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        rows = pd.concat(parts).sort_values(["order", "text"], na_position="first") if parts else pd.DataFrame({"text": [], "y": []})
        model = train(rows["text"].tolist(), rows["y"].to_numpy(int))
        at = np.flatnonzero(model.gram_scores).astype(np.int32)
        yield pd.DataFrame({"bias": [model.bias], "at": [at], "score": [model.gram_scores[at]]})

    [row] = rows.repartition(1).mapInPandas(run, "bias double, at array<int>, score array<double>").toArrow().to_pylist() or [{"bias": 0.0, "at": [], "score": []}]
    return SubwordModel.of(row["at"], row["score"], row["bias"])


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_LABEL, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Null, empty and wordless texts have the score of no words. Without labels of both kinds every score is the same.
    A null doc_id is kept and not held out; repeated rows are scored each; an empty table gives no rows; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = shared.value.texts([v.as_buffer().to_pybytes() if v.is_valid else b"" for v in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
