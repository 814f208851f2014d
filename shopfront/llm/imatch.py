"""Operator 10: I-Match document fingerprints.

Document frequencies are counted over all texts.  The lexicon is the band of
terms that between ``low`` and ``high`` of all documents hold, that is an
inverse-document-frequency band; it has at most (mean distinct terms of a
text) / ``low`` members at any corpus size, so it may be broadcast.  ``LEXICONS``
randomised subsets of it are drawn by hash, from dense (half of the terms) to
sparse.  A fingerprint holds, for each subset, the hash of a text's sorted
distinct terms in it (16 bits, zero if there are none).  An edit spares the hashes
of sparse subsets, and only long texts fill these; so the likeness of two
fingerprints is the largest share of equal hashes, among the subsets that either
fills, over the densities of which at least ``ENOUGH`` are filled.

Terms are runs of letters, lower-cased.  A text without a term of the band is
fingerprinted by all its distinct terms, or by itself if it has none.

Defined results: null text counts as empty; equal texts have equal
fingerprints; an empty table gives an empty table; repeated rows give repeated
results; extra columns are ignored.  For the edited texts, documents follow one
another by doc_id (null first; rows that share a doc_id by the hash of their
text), and a single document follows itself.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed_bytes, partitions, unpacked_bytes
from .grams import mix

TERM = re.compile(r"[^\W\d_]+")
LEXICONS = 64  # at most 64
DENSITIES = 8  # a term is in lexicon i with chance 2 ** -(1 + i % DENSITIES)
ENOUGH = 4


def terms(text: str) -> np.ndarray:
    """48-bit hashes of the distinct terms of a whole text."""
    import xxhash
    found = {w for w in TERM.findall(text.lower())}
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 16 for w in found), "<u8", len(found))


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes and the sums of their counts."""
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, n = h[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


def terms_between(docs: DataFrame, least: float, most: float, flush: int = 500_000) -> DataFrame:
    """(term): those that ``least`` to ``most`` texts hold.

    Tasks count their texts' terms and send each distinct one once (again after
    ``flush`` terms), packed in buckets of the hash; a bucket's task adds up.
    """
    bits = min(20, max(8, (4 * partitions(docs.sparkSession) - 1).bit_length()))

    def rows(h, n):
        edge = np.searchsorted(h >> np.uint64(48 - bits), np.arange((1 << bits) + 1))
        cuts = [(b, x, y) for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if x < y]
        low = h & np.uint64((1 << (48 - bits)) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in cuts], pa.int32()), pa.array([packed_bytes(low[x:y], 5) for _, x, y in cuts], pa.binary()),
             pa.array([packed_bytes(n[x:y], 5) for _, x, y in cuts], pa.binary())], ["bucket", "terms", "counts"])

    def run(batches):
        parts, size = [], 0
        for b in batches:
            got = [terms(t or "") for t in b.column("text").to_pylist()]
            if not got:
                continue
            parts.append(_summed(got, [np.ones(len(g), "<u8") for g in got]) if any(map(len, got)) else (got[0], got[0]))
            size += len(parts[-1][0])
            if size > flush:
                parts = [_summed(*zip(*parts))]
                size = len(parts[0][0])
                if size > flush // 2:
                    yield rows(*parts[0])
                    parts, size = [], 0
        if size:
            yield rows(*_summed(*zip(*parts)))

    def add_up(key, tab):
        h, n = _summed(*([unpacked_bytes(x, 5) for x in tab.column(c).to_pylist()] for c in ("terms", "counts")))
        kept = h[(n >= least) & (n <= most)] | np.uint64(key[0].as_py() << (48 - bits))
        return pa.table([pa.array(kept.astype("<i8"))], ["term"])

    sent = docs.select("text").mapInArrow(run, "bucket int, terms binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add_up, "term long")


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1) -> np.ndarray:
    """Sorted hashes of the terms that ``low`` to ``high`` of all documents, and two at least, hold."""
    n = docs.count()
    return np.sort(terms_between(docs, max(2.0, low * n), high * n).toArrow().column("term").to_numpy().astype("<u8"))


def subsets(t: np.ndarray) -> np.ndarray:
    """Members of the lexicons: one row a term, one column a lexicon."""
    out, left = np.zeros(len(t), np.uint64), np.full(len(t), np.uint64(0xFFFFFFFFFFFFFFFF))
    for d in range(DENSITIES):
        left = left & mix(t + np.uint64((d + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        out |= left & np.uint64(sum(1 << i for i in range(LEXICONS) if i % DENSITIES == d))
    return np.unpackbits(out[:, None].view("u1"), axis=1, bitorder="little")[:, :LEXICONS]


def _hashes(t: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Polynomial hash of each column's terms in their order; 1 to 65535, or 0 for no term."""
    rank = np.cumsum(members, axis=0, dtype=np.int64)
    power = np.cumprod(np.full(int(rank[-1].max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    h = np.where(members, mix(t)[:, None] * power[rank], np.uint64(0)).sum(0, dtype=np.uint64)
    return np.where(rank[-1] > 0, mix(h + rank[-1].astype(np.uint64)) % np.uint64(65535) + np.uint64(1), 0).astype("<u2")


def fingerprint(text: str, band: np.ndarray) -> np.ndarray:
    """One 16-bit hash a lexicon."""
    import xxhash
    t = np.sort(terms(text))
    held = t[:0]
    if len(band) and len(t):
        held = t[band[np.minimum(np.searchsorted(band, t), len(band) - 1)] == t]
    if len(held):
        return _hashes(held, subsets(held))
    if not len(t):
        t = np.array([xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))], np.uint64)
    seeded = t[:, None] + np.arange(LEXICONS, dtype=np.uint64)  # all terms, another hash for each lexicon
    return (mix(mix(seeded).sum(0, dtype=np.uint64)) % np.uint64(65535) + np.uint64(1)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Largest share of equal hashes, over the densities with ``ENOUGH`` filled lexicons, else over all lexicons."""
    if (a == b).all():
        return 1.0
    filled = ((a > 0) | (b > 0)).reshape(-1, DENSITIES).sum(0)
    equal = ((a == b) & (a > 0)).reshape(-1, DENSITIES).sum(0)
    full = filled >= ENOUGH
    return float((equal[full] / filled[full]).max() if full.any() else equal.sum() / filled.sum())


def fingerprints(docs: DataFrame, band: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(band)

    def run(batches):
        for b in batches:
            got = [fingerprint(t or "", shared.value).tobytes().hex() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, " \
         "near_edited double, near_next double"


def _result(doc_id, text: str, following: str, own: np.ndarray, theirs: np.ndarray, band: np.ndarray) -> tuple:
    q = len(text) // 4
    edited = text[:len(text) - q] + following[:q]
    changed = fingerprint(edited, band)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return (doc_id, len(text), sha, own.tobytes(), changed.tobytes(), likeness(own, changed), likeness(own, theirs))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(),
             "part": pa.int32(), "edge": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.binary()))
                                       for i, n in enumerate(names)], names)


def edited_likeness(docs: DataFrame, low: float = 0.001, high: float = 0.1) -> DataFrame:
    """RESULT (digests in hex) for every document, its edited text and the next document by doc_id.

    The texts are dealt once by ranges of doc_id and streamed in order.  The
    last row of a range waits for the first of the next: these rows (two a
    range) are kept aside and met by a join on the range's number.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(lexicon(docs, low, high))
    names = ["part", "edge", "text", *(f.split()[0] for f in RESULT.split(", "))]
    blank = (None,) * 6

    def run(batches):
        band, last, part = shared.value, None, None
        for b in batches:
            out = []
            for doc_id, text, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                own = fingerprint(text, band)
                if last is None:
                    out.append((part, "first", text, doc_id, *blank))
                else:
                    out.append((part, None, None, *_result(last[0], last[1], text, last[2], own, band)))
                last = (doc_id, text, own)
            yield _batch(out, names)
        if last is not None:
            yield _batch([(part, "last", last[1], last[0], *blank)], names)

    ranged = (docs.withColumn("_h", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id")
              .sortWithinPartitions("doc_id", "_h").select("doc_id", "text", F.spark_partition_id().alias("part")))
    done = cut(ranged.mapInArrow(run, f"part int, edge string, text string, {RESULT}"))

    first = done.filter("edge = 'first'").select("part", "text")
    order = Window.orderBy("part")
    ahead = first.select("part").select(F.col("part").alias("before"), F.coalesce(
        F.lead("part").over(order), F.min("part").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    follow = first.withColumnRenamed("text", "following").join(ahead, "part").select("before", "following")
    waiting = done.filter("edge = 'last'").select(F.col("part").alias("before"), "doc_id", "text").join(follow, "before")

    def finish(batches):
        band = shared.value
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")))
            yield _batch([_result(i, t, f, fingerprint(t, band), fingerprint(f, band), band) for i, t, f in rows], names[3:])

    rest = waiting.select("doc_id", "text", "following").mapInArrow(finish, RESULT)
    hexed = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return done.filter("edge is null").select(*names[3:]).unionAll(rest).withColumns(
        {c: F.lower(F.hex(c)) for c in hexed})
