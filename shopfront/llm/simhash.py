"""Operator 5: SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits link when at most ``max_bits`` (up to 3) differ.  The
bits are cut in segments of 23, 23 and 18.  Every 23-bit word decodes to
exactly one codeword of the perfect binary Golay code (an index of 12 bits); a
word and its one-bit neighbours decode to at most six.  Three errors over three
segments leave at most one in each segment, or else at most one in two segments
together.  So one side is indexed by the codeword indices of all three segments,
and by one segment's bits with another's index (7 keys of 30 to 36 bits, few of
which meet by chance); the other side probes with all indices that its
neighbours decode to, and a link's two ends always meet.  Meetings are verified
by the bit distance.

Only distinct fingerprints are compared.  A first round links each fingerprint
to one member of its bucket (verified, no pairs), so that a dense group becomes
a few classes; probes then skip buckets of their own class alone, and join the
rest.  All links between classes are found; copies are never paired.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null doc_id is fingerprinted, and its component is the smallest id
that its group has (null if none); repeated rows give repeated results; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, partitions, unpacked
from .components import components

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
PAIRS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))  # (no error, at most one error)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the binary Golay code
SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of a whole text: majority bit of the XXH64 of its word shingles."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        span = zip(starts[at:min(at + (1 << 16), total)].tolist(), ends[at + k - 1:at + k - 1 + (1 << 16)].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in span), "<u8")
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, *also: str) -> DataFrame:
    """(doc_id, fp) and the long columns ``also``: the fingerprint as a signed long, of every whole text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words_per_shingle) for t in b.column("text").to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view("<i8")), *map(b.column, also)],
                                             ["doc_id", "fp", *also])

    return docs.select("doc_id", "text", *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


class Golay:
    """Nearest codeword index of 23-bit words, by syndrome."""

    def __init__(self):
        rest = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
        self.rest = rest
        self.error = np.zeros(1 << 11, np.int64)
        bits = [1 << i for i in range(23)]
        for e in [0, *bits, *(a | b for a in bits for b in bits if a < b),
                  *(a | b | c for a in bits for b in bits for c in bits if a < b < c)]:
            self.error[(e & 0x7FF) ^ int(rest[e >> 11])] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[(words & 0x7FF) ^ self.rest[words >> 11]]) >> 11

    def near(self, word: np.ndarray, bits: int) -> np.ndarray:
        """Indices of each word and its neighbours, one row a word, sorted."""
        flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
        return np.sort(self.index(word[:, None] ^ flips), axis=1)


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def index_keys(fp: np.ndarray, golay: Golay) -> np.ndarray:
    """One key for all segments and one for each of PAIRS, one row a fingerprint."""
    raw = _segments(fp)
    c = [golay.index(s) for s in raw]
    keys = [(c[0] << 24) | (c[1] << 12) | c[2]]
    keys += [(p << 36) | (raw[x] << 12) | c[y] for p, (x, y) in enumerate(PAIRS, 1)]
    return np.stack(keys, axis=1)


def probe_keys(fp: np.ndarray, golay: Golay) -> list[np.ndarray]:
    """All keys under which a fingerprint with at most three errors is indexed."""
    raw = _segments(fp)
    near = [[np.unique(row) for row in golay.near(s, n)] for s, (_, n) in zip(raw, SEGMENTS, strict=True)]
    out = []
    for i, (a, b, c) in enumerate(zip(*near, strict=True)):
        own = (a, b, c)
        keys = [((a[:, None, None] << 24) | (b[:, None] << 12) | c).ravel()]
        keys += [(p << 36) | (raw[x][i] << 12) | own[y] for p, (x, y) in enumerate(PAIRS, 1)]
        out.append(np.concatenate(keys))
    return out


def _keyed(classes: DataFrame, probe: bool) -> DataFrame:
    """(key, fp, cls) rows of (fp, cls)."""

    def run(batches):
        golay = Golay()
        for b in batches:
            fp = b.column("fp").to_numpy().view("<u8")
            keys = probe_keys(fp, golay) if probe else list(index_keys(fp, golay))
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            flat = np.concatenate(keys).astype("i8") if keys else np.zeros(0, "i8")
            at = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), b.column("fp").take(pa.array(at)), b.column("cls").take(pa.array(at))],
                ["key", "fp", "cls"])

    return classes.select("fp", "cls").mapInArrow(run, "key long, fp long, cls long")


def _classes(distinct: DataFrame, links: DataFrame) -> DataFrame:
    return distinct.select("fp").join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("cls"))


def link_classes(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, cls) of distinct fingerprints: cls is the smallest linked fingerprint.  ``max_bits`` is at most 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("segments are laid out for at most 3 differing bits")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    own = _keyed(distinct.select("fp", F.col("fp").alias("cls")), probe=False)
    picked = [F.min_by("fp", F.xxhash64("fp", F.lit(s))).alias(f"r{s}") for s in range(2)]
    stars = own.join(own.groupBy("key").agg(*picked), "key")
    links = stars.select(F.col("fp").alias("u"), F.explode(F.array("r0", "r1")).alias("v"))
    first = cut(_classes(distinct, links.filter("u <> v").filter(near("u", "v"))))

    index = _keyed(first, probe=False)
    owners = index.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    spread = first.repartition(partitions(distinct.sparkSession), "fp")  # a fingerprint gives a few hundred probe rows
    probes = _keyed(spread, probe=True).join(owners.hint("shuffle_hash"), "key")
    probes = probes.filter("lo <> cls or hi <> cls").select("key", "fp", "cls")
    met = probes.join(index.select("key", F.col("fp").alias("fp2"), F.col("cls").alias("cls2")), "key")
    met = met.filter("cls <> cls2").filter(near("fp", "fp2")).select(
        F.least("cls", "cls2").alias("u"), F.greatest("cls", "cls2").alias("v"))
    joined = components(met)
    return (first.join(joined.withColumnRenamed("node", "cls"), "cls", "left")
            .select("fp", F.coalesce("component", "cls").alias("cls")))


def _with_least(found: DataFrame, order: Column, max_bits: int) -> DataFrame:
    """``found`` with ``least``: the smallest ``order`` that links reach, its own included."""
    distinct = found.groupBy("fp").agg(F.min(order).alias("own"))
    classes = link_classes(distinct, max_bits)
    ids = distinct.join(classes, "fp")
    ids = ids.join(ids.groupBy("cls").agg(F.min("own").alias("least")), "cls").select("fp", "least")
    return found.join(ids, "fp")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach, itself included."""
    found = cut(fingerprints(docs, words_per_shingle))
    return _with_least(found, F.col("doc_id"), max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` from each group: the smallest doc_id (null last), then the smallest hash of the text.

    Rows are told apart by doc_id and text hash, so rows that share only one of them have their own fate.  Of rows that
    share both, the one with the smallest hash of the whole row stays.
    """
    rows = packed(docs, F.xxhash64("text").alias("text_hash"))
    found = cut(fingerprints(rows, words_per_shingle, "text_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["hash"])
    gone = (_with_least(found, order, max_bits).filter(~order.eqNullSafe(F.col("least")))
            .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct())
    rows = rows.drop("text")
    left = rows.join(gone, same(rows, gone), "left_anti")
    again = cut(found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.count("*").alias("n")).filter("n > 1").drop("n"))
    if again.isEmpty():
        return unpacked(left)
    once = left.join(again, same(left, again), "left_anti").select("_row")
    one = left.join(again, same(left, again), "left_semi").groupBy("doc_id", "text_hash").agg(
        F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return unpacked(once.unionAll(one))
