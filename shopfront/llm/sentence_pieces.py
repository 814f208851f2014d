"""Operator 6: SentencePiece encoding and decoding by a distinct-chunk table.

A model whose pieces hold the white-space marker only as a leading run (checked
by ``crossing_pieces``) never merges across the start of a marker run.  So a
text is cut there into marked words, each distinct marked word is segmented
once by the library, and ids (and decoded texts) are joined back by position.
The table lives in a Python worker and is bounded; no text is shuffled.  Models
with crossing pieces, or a normalizer that is more than marking blanks, encode
whole texts instead.

Defined results: null text counts as empty (no ids, empty decoded text); an
empty table gives an empty table; extra columns are ignored; repeated rows
give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkTable

MARK = "▁"
RUNS = re.compile(r" +[^ ]*")

TYPES = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())),
         "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()),
         "decoded_sha256": ("string", pa.string())}


def crossing_pieces(processor) -> list[str]:
    """Pieces in which a marker follows another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return [p for p in pieces if MARK in p.lstrip(MARK)]


class Pieces:
    """Chunk table over one sentencepiece model."""

    #: Blanks, markers and ordinary characters that a normalizer beyond marking would change.
    PROBE = "  a ﬁ①Å　b\tc\n "

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        marked = MARK + self.PROBE.replace(" ", MARK)
        self.by_chunk = not crossing_pieces(self.sp) and self.sp.normalize(self.PROBE) in (marked, self.PROBE)
        self.lead = self.sp.encode("a")
        self.table = ChunkTable(self.segment)

    def segment(self, chunks: list[str]) -> list[tuple[int, str, str, list[int]]]:
        """(count, ids as text, decoded text, ids) of marked words; each starts with a blank."""
        ids = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if not c.strip(" "):  # a run of blanks at the end of a text
                ids[i] = self.sp.encode("a" + c)[len(self.lead):]
        texts = self.sp.decode(ids, num_threads=1) if ids else []
        return [(len(i), ",".join(map(str, i)), " " + t, i) for i, t in zip(ids, texts, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str, list[int]]]:
        """(count, ids as text, decoded text, ids) of whole texts."""
        if not self.by_chunk:
            return [(len(i), ",".join(map(str, i)), self.sp.decode(i), i) for i in map(self.sp.encode, texts)]
        rows = [RUNS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        out = []
        for got in self.table.join(rows):
            n = sum(g[0] for g in got)
            out.append((n, ",".join([g[1] for g in got]), "".join([g[2] for g in got])[1:], got))
        return out


_own: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    """This process's segmenter; a Python worker keeps its table from task to task."""
    if model not in _own:
        _own.clear()
        _own[model] = Pieces(model)
    return _own[model]


def encode_decode(docs: DataFrame, model: bytes, outputs=("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the wanted ``outputs`` (keys of TYPES) of every whole text.

    ``model`` is the bytes of a sentencepiece model file (bounded by its vocabulary).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    outputs = list(outputs)

    def flat(got):
        return [i for g in got for i in (g[3] if isinstance(g, tuple) else [g])]

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    make = {"n_tokens": lambda r: r[0], "ids": lambda r: flat(r[3]), "decoded": lambda r: r[2],
            "ids_sha256": lambda r: sha(r[1]), "decoded_sha256": lambda r: sha(r[2])}

    def run(batches):
        pieces = None
        for b in batches:
            pieces = pieces or pieces_of(shared.value)
            rows = pieces.encode(b.column("text").to_pylist())
            cols = [pa.array([make[o](r) for r in rows], TYPES[o][1]) for o in outputs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *outputs])

    schema = ", ".join(["doc_id long", *(f"{o} {TYPES[o][0]}" for o in outputs)])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) with the library's decode."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for b in batches:
            texts = [sp.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
