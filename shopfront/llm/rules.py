"""Operator 13: text quality by a sparse ensemble of rules over statistics.

1. Every text gets a handful of statistics (one vectorised pass; as Spark columns they took ten times as long).
2. A random forest (Spark ML, shallow trees) is grown on the labelled rows.
   Every path from a root to a node is a conjunction of thresholds; each
   distinct conjunction becomes one rule.
3. A lasso logistic regression (Spark ML) on the rules' truth values gives most rules
   the weight zero.
4. The rules left become Spark column expressions, and the score is the logistic
   function of the sum of their weights.

All labelled rows train, on the executors; the driver holds trees and weights,
whose size follows from ``trees`` and ``depth`` alone.  Weights are rounded to
six digits, so that the order in which partial sums meet does not show.

Defined results: a null text is an empty text, whose shares are 0; it is scored
like any other.  Labels other than 0 and 1 and rows without doc_id are not learned from; a doc_id
with several labels counts as its smallest; with one class (or no labelled text)
every score is the smoothed share of label 1.  Repeated rows give repeated
results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, cut

SPACES = " \t\n\x0b\f\r"
#: Share of a text's characters that fall into each of these sets.
CHARACTER_SETS = {"upper": UPPER, "lower": LOWER, "digit": "0123456789", "space": SPACES, "stop": ".,;:?", "shout": "!",
                  "symbol": "#$%&*|", "bracket": "<>{}[]()=/\\_~^@+\"'`"}
#: Labelled rows that one task of a fit reads, or up to twice as many.
ROWS_PER_TASK = 4096
NAMES = [*CHARACTER_SETS, "words", "distinct_words", "word_length", "line_words", "distinct_lines", "closed_words"]
_DELETED = [chars.encode() for chars in CHARACTER_SETS.values()]
#: Blanks to a space and closing marks to a full stop: a closed word is then ". ".
_ENDS = bytes.maketrans(SPACES.encode() + b",;:!?", b" " * len(SPACES) + b".....")


def statistics(text: str | None) -> list[float]:
    """The statistics ``NAMES`` of a whole text; all finite, 0 for an empty text."""
    chars, data = len(text or ""), (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), data.split(b"\n")  # bytes split at ASCII blanks alone
    n = max(len(words), 1)
    shares = [(len(data) - len(data.translate(None, c))) / max(chars, 1) for c in _DELETED]
    closed = data.translate(_ENDS)
    return [*shares, float(len(words)), len(set(words)) / n, chars / n, len(words) / len(lines),
            len(set(lines)) / len(lines), (closed.count(b". ") + closed.endswith(b".")) / n]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and one double column ``s_<name>`` a statistic of the whole text."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(found[:, i]) for i in range(len(NAMES))]],
                                             [f.name for f in out.fields])

    rows = docs.select("text", *keep)
    out = T.StructType([*rows.schema.fields[1:], *[T.StructField(f"s_{n}", T.DoubleType()) for n in NAMES]])
    return rows.mapInArrow(run, out)


@dataclass(frozen=True)
class Rule:
    """Conjunction: every (statistic, low, high) means low < statistic <= high."""
    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, low, high in self.bounds:
            c = F.col(f"s_{name}")
            found = found & (c > low if low > -math.inf else F.lit(True)) & (c <= high if high < math.inf else F.lit(True))
        return found


def tree_rules(forest) -> list[Rule]:
    """The distinct conjunctions on the paths of all trees, shortest first."""
    def walk(node, bounds: dict) -> Iterator[Rule]:
        if bounds:
            yield Rule(tuple(sorted((n, *b) for n, b in bounds.items())))
        if node.subtreeDepth() == 0:
            return
        name, cut_at = NAMES[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-math.inf, math.inf))
        yield from walk(node.leftChild(), {**bounds, name: (low, min(high, cut_at))})
        yield from walk(node.rightChild(), {**bounds, name: (max(low, cut_at), high)})

    found = {r for tree in forest.trees for r in walk(tree._call_java("rootNode"), {})}
    return sorted(found, key=lambda r: (len(r.bounds), r.bounds))


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weighted: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        """Score from the ``s_...`` columns."""
        z = F.lit(self.bias)
        for rule, weight in self.weighted:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def train(rows: DataFrame, labels: DataFrame, trees: int = 24, depth: int = 3, lasso: float = 0.002,
          rounds: int = 40, seed: int = 13) -> RuleEnsemble:
    """Rule ensemble from the ``measured`` rows (with doc_id) that ``labels`` (doc_id, label 0 or 1) covers."""
    known = (labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id")
             .agg(F.min("label").cast("double").alias("label")))
    rows = cut(rows.join(known, "doc_id").drop("doc_id"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    zeros, ones = sizes.get(0.0, 0), sizes.get(1.0, 0)
    if not zeros or not ones:
        return RuleEnsemble(math.log((ones + 0.5) / (zeros + 0.5)))
    rows = rows.coalesce(1 + (zeros + ones) // ROWS_PER_TASK)  # the fits run many short jobs over a few numbers a row
    features = rows.select("label", array_to_vector(F.array(*[F.col(f"s_{n}") for n in NAMES])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, maxBins=64,
                                    minInstancesPerNode=5).fit(features)
    rules = tree_rules(forest)
    truth = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso_fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=rounds).fit(truth)
    weights = [round(float(w), 6) for w in lasso_fit.coefficients]
    return RuleEnsemble(round(float(lasso_fit.intercept), 6), tuple((r, w) for r, w in zip(rules, weights) if w))


def score(rows: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, score) of ``measured`` rows."""
    return rows.select("doc_id", model.column().alias("score"))


def rate_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, score, predicted); only texts that ``labels`` (doc_id, label) covers are learned from.

    The texts are read once: training joins and scoring reads their statistics, a few numbers a document.
    """
    rows = cut(measured(docs, "doc_id"))
    return score(rows, train(rows, labels, **options)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
