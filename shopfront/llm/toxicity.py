"""Operator 8: toxicity by an n-gram linear classifier with naive Bayes features.

Features are hashed character n-grams (one bucket each), present or not in a
text.  Presence is scaled by the naive Bayes log-count ratio of its bucket
between toxic and other training texts, and a logistic regression weighs the
scaled features.  Training uses a bounded sample: at most ``most`` labelled
texts, those with the smallest hash of doc_id.  Counting and featurizing run on
the executors; the driver gets one count row a bucket (at most ``BUCKETS``) and
for ``most`` rows the places of their features: all buckets whose rates
differ between the classes by ``LEAST_Z`` standard errors or more.

Defined results: a null or empty text has no feature and gets the score of the
bias alone; rows without label or text are not learned from, a doc_id
with several labels counts as its largest; with one class every score is the smoothed share of label 1; an empty table gives an
empty table; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut
from .grams import gram_slices
from .linear import fit_sparse

N = 5
BUCKETS = 1 << 18
LEAST_Z = 6.0  # difference of the classes' rates in standard errors: beyond chance among BUCKETS


def buckets(text: str | None) -> np.ndarray:
    """Distinct n-gram buckets of a whole text, sorted."""
    parts = [np.unique(h & np.uint64(BUCKETS - 1)) for h in gram_slices(text, N)]
    if not parts:
        return np.zeros(0, np.int64)
    return (parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))).astype(np.int64)


@dataclass
class Model:
    place: np.ndarray  # bucket -> feature, or -1
    weight: np.ndarray  # log-count ratio times weight, by feature
    bias: float

    def score(self, text: str | None) -> float:
        at = self.place[buckets(text)]
        z = float(self.weight[at[at >= 0]].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _class_counts(sample: DataFrame):
    """(bucket, n0, n1): texts of each label that hold a bucket, counted in each task before the shuffle."""

    def run(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                n[y, buckets(t)] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["bucket", "n0", "n1"])

    return sample.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, most: int = 8000, l2: float = 1.0) -> Model:
    """Model from the texts of ``docs`` that ``labels`` (doc_id, label 0 or 1) covers.

    The sample is drawn from the labels alone, so the join with the texts broadcasts at most ``most`` rows.
    """
    rows = labels.filter("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int"))
    rows = bounded_sample(rows.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", most)
    sample = cut(docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(rows), "doc_id"))
    counts = _class_counts(sample).toArrow()
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    s0, s1 = sizes.get(0, 0), sizes.get(1, 0)
    n0, n1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    n0[at], n1[at] = counts.column("n0").to_numpy(), counts.column("n1").to_numpy()
    p0, p1 = (n0 + 1) / (s0 + 2), (n1 + 1) / (s1 + 2)
    ratio = np.log(p1 / p0)
    pooled = (n0 + n1 + 2) / (s0 + s1 + 4)
    z = np.abs(p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / (s0 + 1) + 1 / (s1 + 1)))
    kept = np.flatnonzero(z >= LEAST_Z)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def features(batches):
        for b in batches:
            at = [place[buckets(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(
                [a[a >= 0] for a in at], pa.list_(pa.int32()))], ["doc_id", "label", "at"])

    got = sample.mapInArrow(features, "doc_id long, label int, at array<int>").toArrow().sort_by("doc_id")
    held = got.column("at").to_pylist()
    row = np.repeat(np.arange(len(held)), [len(x) for x in held])
    col = np.array([c for x in held for c in x], np.int64)
    weights, bias = fit_sparse(row, col, ratio[kept], got.column("label").to_numpy().astype(float), l2)
    return Model(place, weights * ratio[kept], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            s = [m.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def rate_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, score, predicted); only texts that ``labels`` (doc_id, label) covers are learned from."""
    return score(docs, train(docs, labels, **options)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
