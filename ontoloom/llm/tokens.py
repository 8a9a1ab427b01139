"""Problem 7: encoding of a corpus with a public tokenizer, and decoding.

Texts pass in Arrow batches; each Python worker loads the vocabulary once from a path that is a parameter.  Offsets
come from the byte lengths of the tokens: their prefix sums are byte positions, and the count of non-continuation bytes
before a position is the character position, so a token that splits a character starts and ends inside it.

Results: null and empty texts have the empty list of ids.  Texts are encoded whole, special tokens' strings as ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.json"
#: Characters handed to the library at once: it holds some hundred bytes a token until they are read off.
BATCH_CHARS = 256 << 10


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the others take the code points from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each token by id."""
    t, table = load(path), byte_of_char()
    out = [b""] * t.get_vocab_size()
    for token, i in t.get_vocab().items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text; texts are handed over in pieces of bounded size."""
    t, out, at = load(path), [], 0
    encode_batch = getattr(t, "encode_batch_fast", t.encode_batch)  # the fast one leaves out the library's own offsets
    while at < len(texts):
        piece, size = [], 0
        while at < len(texts) and (not piece or size < BATCH_CHARS):
            piece.append(texts[at] or "")
            size += len(piece[-1])
            at += 1
        out += [np.asarray(e.ids, np.int32) for e in encode_batch(piece, add_special_tokens=False)]
    return out


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def offsets(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the character after its last."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # characters begun before each byte
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    inside = np.concatenate(((raw & 0xC0) == 0x80, [False]))[np.minimum(starts, len(raw))]
    return (before[starts] - inside).astype(np.int32), before[ends].astype(np.int32)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{DEFAULT}", with_offsets: bool = False) -> DataFrame:
    """(key, ids) and, if asked for, char_start and char_end of each token."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = encode_texts(texts, path)
            cols = [b.column(0), lists(ids)]
            if with_offsets:
                n = np.array([len(x) for x in token_bytes(path)], np.int64)
                spans = [offsets(t or "", i, n) for t, i in zip(texts, ids)]
                cols += [lists([s[0] for s in spans]), lists([s[1] for s in spans])]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "ids", "char_start", "char_end"][: len(cols)])

    schema = f"key {kind}, ids array<int>" + ", char_start array<int>, char_end array<int>" * with_offsets
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def count(docs: DataFrame, keep: list[str], text: str = "text", path: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """The columns to keep and n_tokens; ids don't leave the worker."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(i) for i in encode_texts(b.column(b.num_columns - 1).to_pylist(), path)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "n_tokens"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """(key, text): tokens' bytes joined and read as UTF-8, so that characters split over tokens come out whole; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            texts = [None if i is None else b"".join(table[x] for x in i).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
