"""Operator 2: benchmark decontamination by BM25 with block-max WAND.

Test items go into an inverted index: BM25 impacts of their terms (query term
frequency one), divided by the item's own score, in postings ordered by entry
and cut in blocks of entries with the block's largest impact.  Entries are
items, long items as entries of at most ``ENTRY`` words.  Every passage of every
document is a query: windows of ``2 * ENTRY`` words, one each ``ENTRY`` words, so
each run of ``ENTRY`` words lies whole in one.  For a batch of passages, block
by block: passages whose largest impacts add up to less than the threshold stop
(the WAND bound), then (passage, block) pairs whose block maxima do, and only
the rest are scored.  All entries at or above the threshold are retrieved.

A retrieved (document, item) is verified on the words around the passages that
found it: ``overlap`` of the five-word shingles of the whole item must occur, or
else of the question (all sentences but the last) and of the answer (the last
sentence; the whole item if it has one only) both.  Parts of under five words
count as one shingle; a part of under ``WIDE`` words also counts as found if
``overlap`` of its shingles do when it is widened to ``WIDE`` words of the item.
The overlaps reported are the parts', the larger of both counts.

The index is broadcast, in shards of at most ``shard_chars`` characters of item
text (chosen by hash of item_id); more shards mean more passes over the
documents.  Term statistics are those of the whole benchmark, counted in Spark;
the driver gets the counts of one shard's terms at a time.

Defined results: null and empty texts, and items without a word, meet nothing;
ties and repeated items are all reported, repeated (doc_id, item_id) rows once;
an empty table gives an empty table; extra columns are ignored by ``find_leaks``
and kept by ``drop_leaks``; rows with null doc_id are reported with null;
``drop_leaks`` goes by each row's text, whatever its doc_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, unpacked

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
ENTRY = 64
BLOCK = 8
SHINGLE = 5
WIDE = 2 * SHINGLE - 1  # words of a part that has SHINGLE shingles
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    k = min(SHINGLE, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def entries_of(w: list[str]) -> list[list[str]]:
    return [w[i:i + ENTRY] for i in range(0, len(w), ENTRY) if i == 0 or len(w) - i >= SHINGLE] if w else []


@dataclass
class Counts:
    entries: int
    words: int
    holding: dict[str, int]  # term -> entries with it


@dataclass
class Item:
    item_id: int
    whole: set[tuple[str, ...]]
    question: list[set[tuple[str, ...]]]  # as it is, and widened
    answer: list[set[tuple[str, ...]]]

    def overlaps(self, w: list[str]) -> tuple[float, float, float]:
        """Of the whole item, the question and the answer."""
        sides = [self.whole, *self.question, *self.answer]
        have = {k: {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} for k in {len(s) for side in sides for s in side}}
        part = lambda side: sum(s in have[len(s)] for s in side) / len(side)
        return part(self.whole), max(map(part, self.question)), max(map(part, self.answer))


@dataclass
class Index:
    items: list[Item]
    entry_item: np.ndarray
    terms: dict[str, int]
    most: np.ndarray  # largest impact of a term
    block_at: np.ndarray  # term -> its rows of (block, block maximum)
    block: np.ndarray
    block_max: np.ndarray
    post_at: np.ndarray  # (term, block) row -> its postings
    entry: np.ndarray
    impact: np.ndarray


def count_terms(entries: Iterable[list[str]]) -> Counts:
    out = Counts(0, 0, Counter())
    for w in entries:
        out.entries, out.words = out.entries + 1, out.words + len(w)
        out.holding.update(set(w))
    return out


def term_counts(items: DataFrame) -> DataFrame:
    """(shard, term, n, words): entries of all shards that hold a term of a shard; term null: all entries, their words."""

    def run(batches):
        for b in batches:
            shards: dict[int, list] = {}
            for k, t in zip(b.column("shard").to_pylist(), b.column("text").to_pylist()):
                shards.setdefault(k, []).extend(entries_of(words(t)))
            for k, entries in shards.items():
                got = count_terms(entries)
                n = len(got.holding)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * (n + 1), pa.int64()), pa.array([None, *got.holding], pa.string()),
                     pa.array([got.entries, *got.holding.values()], pa.int64()),
                     pa.array([got.words] + [0] * n, pa.int64())], ["shard", "term", "n", "words"])

    own = cut(items.select("shard", "text").mapInArrow(run, "shard long, term string, n long, words long")
              .groupBy("shard", "term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    total = own.groupBy(F.col("term").alias("_term")).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    return cut(own.select("shard", "term").join(total, F.col("term").eqNullSafe(F.col("_term"))).drop("_term"))


def build_index(rows: list[tuple[int, str | None]], counts: Counts | None = None) -> Index:
    """Index of (item_id, text) rows, a bounded shard; ``counts`` are those of all shards (default: of ``rows``)."""
    items, entries = [], []
    for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = words(text)
        if not w:
            continue
        parts = [p for p in SENTENCE.split(text.strip()) if words(p)]
        answer = words(parts[-1]) if len(parts) > 1 else w
        question = words(" ".join(parts[:-1])) if len(parts) > 1 else w
        entries += [(len(items), e) for e in entries_of(w)]
        items.append(Item(item_id, shingles(w), [shingles(question), shingles(w[:max(len(question), WIDE)])],
                          [shingles(answer), shingles(w[-max(len(answer), WIDE):])]))
    vocabulary = sorted({t for _, w in entries for t in w})
    terms = {t: i for i, t in enumerate(vocabulary)}
    counts = counts or count_terms(w for _, w in entries)
    df = np.array([counts.holding[t] for t in vocabulary], float)
    idf = np.log(1 + (counts.entries - df + 0.5) / (df + 0.5))
    mean = counts.words / max(1, counts.entries)
    post = []
    for e, (_, w) in enumerate(entries):
        t, tf = np.unique([terms[x] for x in w], return_counts=True)
        s = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        post += zip(t.tolist(), [e] * len(t), (s / s.sum()).tolist())
    post.sort()
    term = np.array([p[0] for p in post], np.int64)
    entry = np.array([p[1] for p in post], np.int64)
    impact = np.array([p[2] for p in post])
    pairs = term * (len(entries) // BLOCK + 1) + entry // BLOCK
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(post) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(impact, first) if len(post) else impact
    block_at = np.searchsorted(term[first], np.arange(len(terms) + 1))
    most = np.maximum.reduceat(block_max, block_at[:-1]) if len(post) else impact
    return Index(items, np.array([i for i, _ in entries], np.int64), terms, most, block_at, entry[first] // BLOCK,
                 block_max, np.append(first, len(post)), entry, impact)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row, and which place, for all places of [start, stop) of each row."""
    n = stop - start
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n: int, threshold: float):
    """All (passage, entry, score) at or above the threshold; (passage, term) pairs are distinct, passages below n."""
    bar = threshold * (1 - 1e-9)
    able = np.bincount(passage, index.most[term], n) >= bar
    passage, term = passage[able[passage]], term[able[passage]]
    owner, at = _ranges(index.block_at[term], index.block_at[term + 1])
    blocks = int(index.block.max()) + 1
    names, cell = np.unique(passage, return_inverse=True)
    cell = cell[owner] * blocks + index.block[at]
    able = np.bincount(cell, index.block_max[at], len(names) * blocks) >= bar
    owner, at = owner[able[cell]], at[able[cell]]
    row, post = _ranges(index.post_at[at], index.post_at[at + 1])
    key = passage[owner][row] * len(index.entry_item) + index.entry[post]
    key, where = np.unique(key, return_inverse=True)
    score = np.bincount(where, index.impact[post], len(key))
    key, score = key[score >= bar], score[score >= bar]
    return key // len(index.entry_item), key % len(index.entry_item), score


def leaks(index: Index, texts: list[str | None], threshold: float, overlap: float):
    """(text number, item, score, question overlap, answer overlap) of verified items."""
    get = index.terms.get
    docs = [words(t) for t in texts]
    passage, term, first = [], [], [0]
    for w in docs:
        t = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
        at = np.flatnonzero(t >= 0)
        step = at // ENTRY
        last = max(0, -(-len(w) // ENTRY) - 2)  # passage p covers steps p and p + 1
        for shift in (0, 1):
            p = step - shift
            ok = (p >= 0) & (p <= last)
            passage.append(p[ok] + first[-1])
            term.append(t[at[ok]])
        first.append(first[-1] + last + 1)
    if not index.terms or not passage:
        return
    key = np.unique(np.concatenate(passage) * len(index.terms) + np.concatenate(term))
    if not len(key):
        return
    passage, entry, score = retrieve(index, key // len(index.terms), key % len(index.terms), first[-1], threshold)
    doc = np.searchsorted(first, passage, "right") - 1
    found: dict[tuple[int, int], list] = {}
    for d, p, e, s in zip(doc.tolist(), passage.tolist(), entry.tolist(), score.tolist()):
        p -= first[d]
        hit = found.setdefault((d, int(index.entry_item[e])), [p, p, s])
        hit[0], hit[1], hit[2] = min(hit[0], p), max(hit[1], p), max(hit[2], s)
    for (d, i), (low, high, s) in sorted(found.items()):
        around = docs[d][max(0, (low - 1) * ENTRY):(high + 3) * ENTRY]
        whole, q, a = index.items[i].overlaps(around)
        if whole >= overlap or (q >= overlap and a >= overlap):
            yield d, index.items[i].item_id, s, q, a


def indexes(benchmark: DataFrame, shard_chars: int) -> list:
    """One broadcast index a shard of ``benchmark``."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_chars))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    counted = term_counts(items) if shards > 1 else None
    out = []
    for k in range(shards):
        rows, counts = items.filter(F.col("shard") == k).select("item_id", "text").collect(), None
        if counted is not None:
            known = {r["term"]: r for r in counted.filter((F.col("shard") == k) | F.col("term").isNull()).collect()}
            if None in known:
                counts = Counts(known[None]["n"], known[None]["words"], {t: r["n"] for t, r in known.items()})
        out.append(spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in rows], counts)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8,
               shard_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified leak."""

    def scan(index):
        def run(batches):
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                got = [(ids[d], *rest) for d, *rest in leaks(index.value, b.column("text").to_pylist(), threshold, overlap)]
                cols = list(zip(*got)) if got else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        return run

    out = None
    for index in indexes(benchmark, shard_chars):
        got = docs.select("doc_id", "text").mapInArrow(
            scan(index), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = got if out is None else out.unionAll(got)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in (
        "score", "question_overlap", "answer_overlap")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8,
               shard_chars: int = 4 << 20) -> DataFrame:
    """``docs`` without the rows whose text holds a verified test item: each row by its own text, without a shuffle."""

    def clean(index):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for d, *_ in leaks(index.value, b.column("text").to_pylist(), threshold, overlap):
                    keep[d] = False
                yield b.filter(pa.array(keep))
        return run

    rows = packed(docs).select("text", "_row")
    for index in indexes(benchmark, shard_chars):
        rows = rows.mapInArrow(clean(index), rows.schema)
    return unpacked(rows)
