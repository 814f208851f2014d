"""Operator 1: token-id output as Parquet list columns.

``write_tokens`` encodes whole texts and writes them in ascending doc_id order;
``read_tokens`` and ``read_ids`` read the files back, whole or selectively.

File format (one Parquet file per range of doc_id; names sort like the ranges):

* ``doc_id`` long, ``part`` int (the file's range), ``n_tokens`` int: delta
  encoded (data page version 2, dictionary off);
* ``ids`` list of int: dictionary encoded; the vocabulary fits one dictionary
  page, so pages hold packed indices;
* row groups of ``row_group_bytes``, data pages of at most ``page_rows`` rows,
  so the column and offset indexes let a reader of a few doc_ids fetch only
  the pages that hold them, and a reader of ``n_tokens`` never touch ``ids``.

Defined results: null text counts as empty (only the end id); an empty table
gives an empty table; extra columns are ignored; a null doc_id sorts first;
rows with equal doc_id follow one another, ordered by file and then by their
ids' checksum.  Ranges are of doc_id and then of the text's hash, so an id (or
null) that many rows share is spread over several files.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ChunkTable, partitions, scratch

FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.size": str(256 << 10),
    "compression": "zstd",
}

#: What keeps chunks (joined by blanks) from being segmented on their own: a blank next to other white space (an empty
#: chunk, or one with white space at an end), separators that libraries tell apart differently, and the start of an
#: added token.
AWKWARD = re.compile(r"\s\s|[\x1c-\x1f]|<\|")

#: A word of Latin letters (code points to U+024F) and ASCII punctuation that starts no contraction or added token.
ENDED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:;=-@\[-^`{}~]+)")


def splits_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer is one for which the chunks of a text can be segmented on their own (see ``ByteBpe``)."""
    first = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
            and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or []))


class ByteBpe:
    """Encodes texts with the tokenizers library, each distinct blank-led chunk once.

    The byte-level pre-tokenizer starts a new pre-token at every blank between
    two other characters, and merges never cross pre-tokens; so the ids of a
    text are the ids of its chunks in a row.  An AWKWARD chunk has no value, and
    its text goes whole; so do all texts if the tokenizer is of another kind.
    """

    JOINED = 256  # unseen chunks that go to the library as one text
    KEPT = 400_000  # chunks that come into use before those not used for as long are forgotten

    def __init__(self, spec: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.by_chunk = splits_at_blanks(json.loads(spec))
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.leads = np.array([n is not None and n.startswith("Ġ") for n in names])  # ids that start with a blank
        self.table = ChunkTable(self.segment, limit=self.KEPT)

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in got]

    def words(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks that follow a blank; no chunk holds a blank, so each has one id that starts with it."""
        out: list[bytes | None] = []
        for i in range(0, len(chunks), self.JOINED):
            part = chunks[i:i + self.JOINED]
            text = " " + " ".join(part)
            if AWKWARD.search(text + " "):
                out += [None if AWKWARD.search(f" {c} ") else self.whole([" " + c])[0] for c in part]
                continue
            raw = self.whole([text])[0]
            cut = [*(np.flatnonzero(self.leads[np.frombuffer(raw, "<u4")]) * 4).tolist(), len(raw)]
            out += [raw[x:y] for x, y in zip(cut, cut[1:], strict=False)]
        return out

    def segment(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks: a text's start, marked by a leading blank; else a blank and the chunk.

        A word with punctuation behind it is two pre-tokens, so its word is
        looked up, and segmented only if the table does not hold it.
        """
        table, out, ended = self.table, {}, {}
        own = [c for c in chunks if c[:1] == " "]
        for c, ids in zip(own, self.whole([c[1:] for c in own]), strict=True):
            out[c] = None if AWKWARD.search(f"{c} ") else ids
        for c in chunks:
            if not c.isalpha() and (m := ENDED.fullmatch(c)):
                ended[c] = m
        fresh = dict.fromkeys(c for c in chunks if c not in out and c not in ended)
        for m in ended.values():
            word = m[1]
            if word not in fresh and word not in out:
                ids = table.known.get(word) or table.older.get(word)
                if ids is None:
                    fresh[word] = None
                else:
                    out[word] = ids
        out.update(zip(fresh, self.words(list(fresh)), strict=True))
        ends = list({m[2] for m in ended.values()})
        ends = dict(zip(ends, self.whole(ends), strict=True))
        for c, m in ended.items():
            word = m[1]
            out[c] = out[word] + ends[m[2]]
            if len(word) <= table.longest:
                table.known[word] = out[word]
        return [out[c] for c in chunks]

    def encode(self, texts: pa.Array, tail: bytes) -> list[bytes]:
        """Ids of whole texts (no nulls), ``tail`` after each.

        The chunks of all texts are one Arrow array, dictionary encoded: the
        table is asked for the batch's distinct chunks, and their ids, as
        binary values, are taken by position.
        """
        if not self.by_chunk or not len(texts):
            return [ids + tail for ids in self.whole(texts.to_pylist())]
        split = pc.split_pattern(texts, " ")  # an empty text has one (empty) chunk
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        chunks, start = split.flatten(), np.zeros(at[-1], bool)
        start[at[:-1]] = True
        own = pc.binary_join_element_wise("", chunks.filter(pa.array(start)), " ")  # no other chunk holds a blank
        coded = pc.replace_with_mask(chunks, pa.array(start), own).dictionary_encode()
        found = self.table.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        place = coded.indices.to_numpy()
        values = pa.array(found, pa.large_binary())
        whole = np.logical_or.reduceat(values.is_null().to_numpy(zero_copy_only=False)[place], at[:-1])
        ids = values.take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], "i8")[at].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [(self.whole([texts[i].as_py()])[0] if w else bytes(data[x:y])) + tail
                for i, (w, x, y) in enumerate(zip(whole.tolist(), ends, ends[1:], strict=False))]


def gathered(batches, column: str = "text", least: int = 4 << 20):
    """Arrow batches put together until ``column`` holds ``least`` bytes: fewer distinct chunks in sum."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


_own: dict[str, ByteBpe] = {}


def byte_bpe(spec: str) -> ByteBpe:
    """This process's encoder; a Python worker keeps its table from task to task."""
    if spec not in _own:
        _own.clear()
        _own[spec] = ByteBpe(spec)
    return _own[spec]


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0,
                 row_group_bytes: int = 32 << 20, page_rows: int = 512) -> None:
    """Encode ``docs(doc_id, text)`` and write the files described above under ``path``.

    ``tokenizer_json`` is the text of a tokenizers JSON file (its size is bounded by
    the vocabulary).  One range shuffle of the texts; every task streams its range.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(tokenizer_json)
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        bpe = None
        for b in gathered(batches):
            bpe = bpe or byte_bpe(spec.value)
            raw = bpe.encode(b.column("text"), tail)
            n = np.fromiter((len(x) // 4 for x in raw), "i4", len(raw))
            offsets = np.concatenate([[0], np.cumsum(n, dtype="i8")]).astype("i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(n), ids],
                                             ["doc_id", "part", "n_tokens", "ids"])

    ranged = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
              .repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
              .withColumn("part", F.spark_partition_id()))
    (ranged.mapInArrow(run, "doc_id long, part int, n_tokens int, ids array<int>")
     .write.options(**FORMAT).option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.row.count.limit", str(page_rows)).parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, n_tokens, ids) of all documents; unselected columns are not read."""
    return spark.read.schema("doc_id long, part int, n_tokens int, ids array<int>").parquet(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; the filter reaches row groups and pages."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(*doc_ids)).select("doc_id", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, part, n_tokens, ids_crc32) counted from the ids that the files hold."""

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(np.diff(at).astype("i8")), pa.array(crc, pa.int64())],
                ["doc_id", "part", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "part", "ids").mapInArrow(
        run, "doc_id long, part int, n_tokens long, ids_crc32 long")


def with_starts(sums: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``start`` to the ``checksums`` of ``tokens``: ids of all documents before, by doc_id.

    A running sum inside each file's range, plus the sums of the ranges before
    it (one row per file, from the files' ``n_tokens`` alone).
    """
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens")
    ranges = Window.orderBy("part")
    before = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", (F.sum("_n").over(ranges) - F.col("_n")).alias("_before"))
    local = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return (sums.withColumn("_local", local).join(before, "part")
            .select("doc_id", (F.col("_before") + F.col("_local")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, tokenizer_json: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the token files (to ``path``, or a new folder of the shared checkpoint folder) and report what they hold."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_json, end_id)
    tokens = read_tokens(spark, path)
    return with_starts(checksums(tokens), tokens)
