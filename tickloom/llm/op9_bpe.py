"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are encoded, only where a white-space character
follows another character: no match of the pattern spans such a place, and none
that ends there looks beyond it, so the pieces give the ids of the whole text.
A piece that is still long, a run of letters or blanks, say, is more than the
library's own pattern matcher can take; its matches are found here and encoded
one at a time by the library, in time that grows with their length.  Decoding
joins the raw bytes of the ids before anything is read as UTF-8.

Defined results: null texts count as empty, and an empty text has no ids; the
strings of special tokens are ordinary text; texts and words of any length are
encoded whole; a repeated row gives its result again, and null or equal ids
change nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Code points after which a long text is cut at the next safe place.
CUT = 1 << 16
#: Code points up to which the library matches the pattern in a piece itself.
LONG = 1 << 18

_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_loaded: dict = {}


class Coder:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    @classmethod
    def at(cls, path: str, pattern: str) -> Coder:
        """The coder of this worker for a rank file; the file is read once."""
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def encode(self, text: str, cut: int = CUT, long: int = LONG) -> list[int]:
        if len(text) <= min(cut, long):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text, cut):
            if len(piece) <= long:
                ids += self.encoding.encode_ordinary(piece)
            else:
                for match in self.matches.finditer(piece):
                    ids += self.encoding._core_bpe.encode_single_piece(match[0].encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def joined(self, ids: list[int]) -> str:
        names = self.names
        return ",".join([names[i] for i in ids])


def pieces(text: str, cut: int = CUT) -> Iterator[str]:
    """The text in order, cut at the first safe place after every ``cut`` code points."""
    at = 0
    while len(text) - at > cut and (found := _SAFE.search(text, at + cut)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def tokenised(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder.at(path, pattern)
        ids = [coder.encode(x) for x in common.texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids array<int>")


def detokenised(rows: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, raw) of (doc_id, ids): the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder.at(path, pattern)
        raw = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return common.map_batches(rows.select("doc_id", "ids"), run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``keep_ids`` ids: each text encoded, and its ids decoded, in one pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = Coder.at(path, pattern)
        counts, ids_hash, raw_hash, kept = [], [], [], []
        for text in common.texts(batch.column(1)):
            ids = coder.encode(text)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(coder.joined(ids).encode()).hexdigest())
            raw_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if keep_ids:
                kept.append(np.array(ids, np.int32))
        cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names + ["ids"] * keep_ids)

    return common.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training corpus: the ids of every document it is given, with their count and digests."""
    common.session(spark)
    return round_trip(docs, public_tokenizers.path(RANKS), keep_ids=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
