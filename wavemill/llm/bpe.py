"""Byte-level BPE encoding and decoding with the tiktoken library.

A rank file is read once in each Python worker.  Long texts are cut before
encoding at boundaries where no pre-token can reach across (a white-space
character after one that is none, or a mark after an ideograph), so the pieces
encode independently and the ids are those of the whole text.  A run of letters
without any such place is one pre-token and stays whole.  Decoding joins the raw bytes of the ids.

Null text counts as empty: no ids, no bytes.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, id_text, table, trimmed

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Texts over this many characters are cut at safe boundaries into pieces of about this size.
PIECE_CHARS = 1 << 16
#: White-space runs over this many characters are matched outside the library's regex engine.
LONG_RUN = 10_000

# Before white space after anything else, and between an ideograph or kana and a mark: no pre-token has both.
_SAFE = re.compile(r"(?<=\S)[ \n\t\r]|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")
_RUN = re.compile(r"\s{%d}" % LONG_RUN)
_LOADED: dict = {}


def encoding(path: str | None = None, pattern: str | None = None):
    """The tiktoken encoding of a rank file (default: the public multi-language one), loaded once per process."""
    import public_tokenizers
    import tiktoken

    key = (path, pattern)
    if key not in _LOADED:
        with open(path or public_tokenizers.path(RANK_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[key] = tiktoken.Encoding("local", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a long text where no pre-token can cross."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc, text: str, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    ids: list[int] = []
    for part in pieces(text, size):
        if _RUN.search(part):
            import regex

            for m in regex.finditer(enc._pat_str, part):
                ids += enc._encode_single_piece(m.group())
        else:
            ids += enc.encode_ordinary(part)
    return ids


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                ids = [np.array(encode_text(enc, t or ""), dtype=np.int32) for t in b.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for whole in batches:
            for b in batches_of(whole, "text", 4 << 20):
                n = [len(encode_text(enc, t or "")) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, n_tokens long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, bytes``: the raw bytes of the ids (they need not be valid UTF-8 for foreign ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = b.column("ids")
            flat, offsets = np.asarray(ids.flatten()), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            out = [enc.decode_bytes(flat[x:y].tolist()) for x, y in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids array<int>, bytes binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
