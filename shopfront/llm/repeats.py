"""Operator 9: substring dedup with fixed-block anchors.

A window of ``size`` words that also starts elsewhere is a repeat.  Documents
are cut in reference blocks of ``(size + 1) // 2`` words, one after another; any
window holds a whole block.  So if two windows are equal, the block inside one
equals a rolling window (of a block's length) inside the other.

1. Anchors.  Every rolling window's hash is a probe, the blocks' among them are
   the index.  Probes meet by hash; a hash that a block has and that starts in
   more than one place is a hit, at each of its places.
2. Extension.  Around each hit the windows of ``size`` words that hold it are
   candidates; their hashes (64 bits, and their place's bucket) meet again, and
   those that start in two places or more are exact repeats.  Consecutive ones
   together cover a maximal repeat.
3. Removal.  Words covered by a repeat are dropped from their document.

Meeting place.  A task hashes a batch of documents (about ``BATCH`` words),
groups equal hashes inside the batch at once, and sends every distinct hash
once, with its first place in the batch: sorted by hash and packed as columns
of bytes, one row a (batch, bucket).  A hash that a third of all documents
share thus costs one entry a batch.  The bucket's task finds hashes of several
batches and answers each batch with places.  In the first meeting 32 bits of
the hash are sent beside the bucket; a chance meeting only adds candidates,
which the second meeting's whole hash throws out.

Batches are named by partition and number, so ``docs`` must be read from files
(or a checkpoint): a recomputed task then sees the same rows in the same order.
Documents are joined by the 64-bit hash of (doc_id, text), so null and repeated
ids are safe.

Defined results: null text has no words; repeated rows are different places, so
a text of ``size`` words or more that occurs twice is removed in both; texts
under ``size`` words stay; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_bytes, partitions, unpacked_bytes
from .grams import mix

SIZE = 35
BATCH = 1 << 20  # words; places in a batch take 3 bytes
FACTOR = 0x9E3779B97F4A7C15


def split(text: str | None) -> list[bytes]:
    """Words of a whole text: runs of bytes other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(w: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh64_intdigest, w), "<u8", len(w))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, have, power, width = None, 0, h, 1  # power: hashes of runs of ``width``
    while True:
        if n & width:
            if done is None:
                done, have = power, width
            else:
                m = len(h) - have - width + 1
                done = done[:m] * np.uint64(pow(FACTOR, width, 1 << 64)) + power[have:have + m]
                have += width
        if have == n:
            return mix(done)
        m = len(power) - width
        power = power[:m] * np.uint64(pow(FACTOR, width, 1 << 64)) + power[width:]
        width *= 2


def _runs(places: np.ndarray) -> bytes:
    """Sorted places as (first, last) pairs of consecutive ones."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.append(0, cut + 1)], places[np.append(cut, -1)]], axis=1).astype("<u4").tobytes()


def _within(runs: list[bytes], before: int, after: int, n: int) -> np.ndarray:
    """Which of n words lie from ``before`` words ahead of a place to ``after`` words behind one."""
    pairs = np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(pairs[:, 0] - before, 0), 1)
    np.add.at(step, np.minimum(pairs[:, 1] + after + 1, n), -1)
    return np.cumsum(step)[:n] > 0


MESSAGE = "bucket int, batch long, kind string, a binary, b binary"
NAMES = ["bucket", "batch", "kind", "a", "b"]


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], NAMES)


class Batch:
    """Hashes of some documents on their way to the meeting."""

    def __init__(self):
        self.keys, self.starts, self.bases, self.words = [], [], [], 0
        self.hashes, self.places, self.marks = [], [], []

    def add(self, key: int, base: int, n_words: int, hashes: np.ndarray, places: np.ndarray, marks: np.ndarray) -> None:
        """``n_words`` words of a document from its word ``base``; places count from there."""
        self.keys.append(key)
        self.starts.append(self.words)
        self.bases.append(base)
        self.hashes.append(hashes)
        self.places.append(places + self.words)
        self.marks.append(marks)
        self.words += n_words

    def messages(self, name: int, bits: int, size: int) -> list[tuple]:
        """Rows of MESSAGE: the documents, the hits inside the batch, and the packed probes of each bucket."""
        own = int(mix(np.array([name], np.uint64))[0] >> np.uint64(64 - bits))
        docs = (own, name, "docs", np.array(self.keys, "<i8").tobytes(),
                np.array([self.starts, self.bases], "<i8").tobytes())
        h = np.concatenate(self.hashes)
        order = np.argsort(h, kind="stable")
        h, place, mark = h[order], np.concatenate(self.places)[order], np.concatenate(self.marks)[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(h)))
        again = np.repeat(n > 1, n)
        out = [docs]
        if again.any():
            out.append((own, name, "hits", packed_bytes(np.sort(place[again]), 3), b""))
        if len(h):
            marked = np.logical_or.reduceat(mark, first).astype(np.uint64)
            h, ref = h[first], place[first].astype(np.uint64) | marked << np.uint64(23)
            edge = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            low = (h >> np.uint64(64 - bits - 32)) & np.uint64(0xFFFFFFFF) if size == 4 else h
            out += [(b, name, "probes", packed_bytes(low[x:y], size), packed_bytes(ref[x:y], 3))
                    for b, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if x < y]
        return out


def _meet(messages: DataFrame, size: int) -> DataFrame:
    """(key, places) by document: runs of word numbers where hashes of its batch were met, from MESSAGE rows."""

    def owner(tab: pa.Table) -> pa.Table:
        rows = list(zip(*(tab.column(c).to_pylist() for c in NAMES)))
        out = [r for r in rows if r[2] != "probes"]
        probes = [r for r in rows if r[2] == "probes"]
        if len(probes) > 1:
            h = np.concatenate([unpacked_bytes(r[3], size) for r in probes])
            ref = np.concatenate([unpacked_bytes(r[4], 3) for r in probes])
            who = np.repeat(np.arange(len(probes)), [len(r[4]) // 3 for r in probes])
            order = np.argsort(h, kind="stable")
            h, ref, who = h[order], ref[order], who[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            met = np.repeat((n > 1) & (np.bitwise_or.reduceat(ref, first) >> np.uint64(23) & np.uint64(1)).astype(bool), n)
            place, who = ref[met] & np.uint64((1 << 23) - 1), who[met]
            order = np.lexsort((place, who))
            place, who = place[order], who[order]
            edge = np.searchsorted(who, np.arange(len(probes) + 1))
            out += [(r[0], r[1], "hits", packed_bytes(place[x:y], 3), b"")
                    for r, x, y in zip(probes, edge[:-1].tolist(), edge[1:].tolist()) if x < y]
        return pa.Table.from_batches([_message(out)])

    def resolve(tab: pa.Table) -> pa.Table:
        rows = list(zip(*(tab.column(c).to_pylist() for c in NAMES)))
        keys, bases, places = [], [], []
        docs = [r for r in rows if r[2] == "docs"]
        hits = [unpacked_bytes(r[3], 3).astype(np.int64) for r in rows if r[2] == "hits"]
        if docs and hits:
            key, (start, base) = np.frombuffer(docs[0][3], "<i8"), np.frombuffer(docs[0][4], "<i8").reshape(2, -1)
            at = np.unique(np.concatenate(hits))
            doc = np.searchsorted(start, at, "right") - 1
            edge = np.searchsorted(doc, np.arange(len(key) + 1))
            for i in np.unique(doc).tolist():
                keys.append(int(key[i]))
                bases.append(int(base[i]))
                places.append(_runs(at[edge[i]:edge[i + 1]] - start[i] + base[i]))
        return pa.table([pa.array(keys, pa.int64()), pa.array(bases, pa.int64()), pa.array(places, pa.binary())],
                        ["key", "base", "places"])

    answers = messages.groupBy("bucket").applyInArrow(owner, MESSAGE)
    found = answers.groupBy("batch").applyInArrow(resolve, "key long, base long, places binary")
    found = found.groupBy("key", "base").agg(F.max("places").alias("places"))  # those of repeated rows are alike
    return found.groupBy("key").agg(F.collect_list("places").alias("places"))  # one entry a BATCH words of a text


def _send(batches, bits: int, size: int, hashes):
    """MESSAGE rows of a task; ``hashes(row)`` gives (key, words, hashes, places, marks) or None.

    A text over BATCH words goes in several batches.
    """
    from pyspark import TaskContext
    part, number, held = TaskContext.get().partitionId(), 0, Batch()

    def flush():
        return _message(held.messages((part << 32) | number, bits, size))

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            got = hashes(*row)
            if got is None:
                continue
            key, n_words, h, places, marks = got
            for base in range(0, n_words, BATCH):
                n = min(BATCH, n_words - base)
                if held.keys and held.words + n > BATCH:
                    yield flush()
                    number, held = number + 1, Batch()
                own = slice(*np.searchsorted(places, [base, base + n]))
                held.add(key, base, n, h[own], places[own] - base, marks[own])
    if held.keys:
        yield flush()


def _bits(docs: DataFrame) -> int:
    return min(20, max(4, (4 * partitions(docs.sparkSession) - 1).bit_length()))


def repeats(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, places): where windows of ``size`` words start that also start elsewhere; from (key, text, doc_id)."""
    block, bits = (size + 1) // 2, _bits(keyed)

    def anchors(key, text):
        h = word_hashes(split(text))
        if len(h) < size:
            return None
        at = np.arange(len(h) - block + 1)
        return key, len(h), rolling(h, block), at, at % block == 0

    def windows(key, text, places, _):
        h = word_hashes(split(text))
        last = len(h) - size
        if last < 0:
            return None
        start = np.flatnonzero(_within(places, size - block, 0, len(h))[:last + 1])
        return key, len(h), rolling(h, size)[start], start, np.ones(len(start), bool)

    probes = keyed.select("key", "text").mapInArrow(lambda b: _send(b, bits, 4, anchors), MESSAGE)
    hits = _meet(probes, 4)
    # sorted, so that a recomputed task forms the same batches; doc_id, so that both joins read one exchange
    near = keyed.join(hits, "key").select("key", "text", "places", "doc_id").sortWithinPartitions("key")
    return _meet(near.mapInArrow(lambda b: _send(b, bits, 8, windows), MESSAGE), 8)


def drop_repeats(docs: DataFrame, size: int = SIZE, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and the kept words as ``kept`` if ``texts``."""
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeats(keyed, size)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * texts]

    def remove(batches):
        for b in batches:
            out = []
            for doc_id, text, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "places"))):
                w = split(text)
                kept = w
                if places:
                    kept = [x for x, c in zip(w, _within(places, 0, size - 1, len(w)).tolist()) if not c]
                line = b" ".join(kept)
                out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(line).hexdigest(), line.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    return (keyed.join(found, "key", "left").select("doc_id", "text", "places")
            .mapInArrow(remove, schema))
