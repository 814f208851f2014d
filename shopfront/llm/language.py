"""Operator 3: language identification with language-bitmask n-gram filters.

Training finds, for each language, the character n-grams that are common in it
and not much more common elsewhere.  All languages' n-gram sets share one
bit-sliced Bloom filter: a slot holds a mask with one bit a language, so the
AND of an n-gram's slots returns every language that (perhaps) holds it.  A
text is decided by the popcount of each language over its n-grams, corrected
for the filter's false positives: (hits - n * f) / (1 - f), with f the chance
that all slots of an unknown n-gram have the language's bit.

The classifier is fitted on a bounded sample: at most ``most`` whole texts of
each language, those with the smallest hash of doc_id.  An n-gram enters a
language's set only if ``least_rate`` of its texts hold it, so a set has at
most (mean distinct n-grams of a text) / least_rate members at any corpus size.

Defined results: null texts and texts without a letter are ``und`` with score
0; with nothing learned every text is ``und`` (``keep_identified`` then keeps texts with a letter); rows without language or text
are not learned from; ties go to the language that sorts first; an empty table
gives an empty table; repeated rows give repeated results; extra columns are
ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, packed, unpacked
from .grams import gram_slices, mix

N = 4
PROBES = 3


def _slots(h: np.ndarray, m: int) -> list[np.ndarray]:
    """PROBES slots of each hash in a filter of m (a power of two) slots."""
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(m - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false: np.ndarray  # chance of a false positive for each language

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """n-grams of a text, and for each language how many its filter holds."""
        total, hits = 0, np.zeros(self.masks.shape[1] * 64, np.int64)
        for h in gram_slices(text, N):
            found = np.bitwise_and.reduce([self.masks[s] for s in _slots(h, len(self.masks))])
            total += len(h)
            if found.shape[1] == 1:
                kinds, n = np.unique(found[:, 0], return_counts=True)
                bits = np.unpackbits(kinds[:, None].view("u1"), axis=1, bitorder="little")
                hits += n @ bits
            else:
                hits += np.unpackbits(found.view("u1"), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return total, hits[:len(self.langs)]

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (share of the corrected counts) and coverage (corrected share of the n-grams)."""
        total, hits = self.counts(text)
        if not total or not self.langs:
            return "und", 0.0, 0.0
        fixed = np.maximum((hits - total * self.false) / (1 - self.false), 0)
        best, whole = int(fixed.argmax()), float(fixed.sum())
        return self.langs[best], float(fixed[best] / whole) if whole else 0.0, float(min(1, fixed[best] / total))


def train(docs: DataFrame, most: int = 1000, least_rate: float = 0.005, share: float = 0.25) -> Filters:
    """Filters from (doc_id, text, lang); a set takes n-grams whose rate is at least ``share`` of their best rate."""
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = cut(bounded_sample(rows, "doc_id", most, by="lang"))

    def run(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            texts = b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                grams = [np.unique(np.concatenate(s)) for t, x in zip(texts, langs) if x == lang
                         and (s := list(gram_slices(t, N)))]
                if grams:
                    g, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g)), pa.array(g.view("<i8")), pa.array(n.astype("i8"))],
                        ["lang", "gram", "n"])

    sizes = sample.groupBy("lang").agg(F.count("*").alias("docs"))
    counts = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rated = counts.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("n") / F.col("docs"))
    common = rated.filter((F.col("rate") >= least_rate) & (F.col("n") >= F.least(F.lit(2), F.col("docs"))))
    top = common.groupBy("gram").agg(F.max("rate").alias("top"))
    rows = common.join(top, "gram").filter(F.col("rate") >= share * F.col("top")).select("lang", "gram").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    where = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.int64)
    grams = rows.column("gram").to_numpy().astype("<i8").view("<u8")
    most_grams = int(np.bincount(where).max()) if len(where) else 1
    m = 1 << max(10, int(np.ceil(np.log2(8 * most_grams))))
    masks = np.zeros((m, max(1, -(-len(langs) // 64))), np.uint64)
    for s in _slots(grams, m):
        np.bitwise_or.at(masks, (s, where // 64), np.uint64(1) << (where % 64).astype(np.uint64))
    fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filters(langs, masks, np.minimum(fill ** PROBES, 0.999))


def predict(docs: DataFrame, filters: Filters, *carry: str) -> DataFrame:
    """(carried columns, lang_pred, score, coverage) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = shared.value
        for b in batches:
            got = [f.decide(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in carry], pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())],
                [*carry, "lang_pred", "score", "coverage"])

    rows = docs.select("text", *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in carry)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, coverage double")


def identify(docs: DataFrame, learn_from: DataFrame, **options) -> DataFrame:
    """(doc_id, lang_pred, score, coverage); only ``learn_from`` (doc_id, text, lang) is learned from."""
    return predict(docs, train(learn_from, **options), "doc_id")


def keep_identified(docs: DataFrame, learn_from: DataFrame, least_coverage: float = 0.05, **options) -> DataFrame:
    """``docs`` without rows in ``und`` and rows whose n-grams hardly occur in their language (coverage).

    Where nothing can be learned (no row has a language), no row can be held
    against one: rows with a letter stay.
    """
    filters = train(learn_from, **options)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        f = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            if f.langs:
                keep = [lang != "und" and cover >= least_coverage for lang, _, cover in map(f.decide, texts)]
            else:
                keep = [f.counts(t)[0] > 0 for t in texts]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("_row").filter(keep)], ["_row"])

    rows = packed(docs).select("text", "_row")
    kept = rows.mapInArrow(run, rows.select("_row").schema)
    return unpacked(kept)
