"""Helpers shared by the text operators: the shared folder, and words and hashes over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from taxaloom.package import ship

__all__ = ["ngram_hashes", "mix", "shared_dir", "ship", "signed", "stored", "text_bytes", "text_groups", "word_hashes", "word_spans"]

#: Separators of a word: space and the control characters 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text handled at once; a longer word or document enlarges its own block only.
BLOCK_BYTES = 2 << 20

U64 = np.uint64
M1, M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder (URI) under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing a temporary folder becomes the checkpoint folder, in local mode only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            root = jsc.getCheckpointDir().get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and root.startswith("/"):
        root = "file://" + root
    elif root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: its lineage ends there."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= M1
    h ^= h >> U64(27)
    h *= M2
    h ^= h >> U64(31)
    return h


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
#: Masks for the first k bytes of eight, and the eights of a word that are hashed word by word; of a longer word all together.
_TAIL, _TURNS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64), 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 offsets of the rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(column) else raw[:0], at - at[0]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch and the n + 1 offsets of the rows among them."""
    hashes, starts, _, rows = _words(column, lower)
    return hashes, rows


def word_spans(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, the rows' offsets among the words, and the bytes."""
    raw, _ = text_bytes(column)
    return *_words(column, lower), raw


def _words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, at = text_bytes(column)
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_IS_SEPARATOR[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < n]
    first[begins] |= inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(_LOWER[raw] if lower else raw, starts, ends), starts, ends, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes: the mixed sum of its eights, each mixed with its place, and its length.

    Stretches of one length of up to eight bytes never share a hash.
    """
    length = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    total = mix(view[starts] & _TAIL[np.minimum(length, 8)])
    k, open_ = 1, np.flatnonzero(length > 8)
    while len(open_) and k < _TURNS:
        left = length[open_] - 8 * k
        total[open_] += mix((view[starts[open_] + 8 * k] & _TAIL[np.minimum(left, 8)]) ^ _places(k, k + 1))
        open_, k = open_[left > 8], k + 1
    for i in open_.tolist():
        for begin in range(int(starts[i]) + 8 * k, int(ends[i]), BLOCK_BYTES):
            part = padded[begin : min(begin + BLOCK_BYTES, ends[i])]
            eights = np.concatenate([part, np.zeros(-len(part) % 8, np.uint8)]).view("<u8")
            place = (begin - int(starts[i])) // 8
            total[i : i + 1] += mix(eights ^ _places(place, place + len(eights))).sum(dtype=U64)
    return mix(total + length.astype(U64) * M1)


def _places(a: int, b: int) -> np.ndarray:
    return mix(np.arange(a, b, dtype=U64) * U64(0x9E3779B97F4A7C15))


def ngram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k words (of one row's words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, U64)
    for j in range(k):
        total *= U64(0x9FB21C651E98DF25)
        total += words[j : j + n]
    return mix(total)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers, as Spark's long holds them."""
    return h.view(np.int64)


def text_groups(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``limit`` characters, with the index of their first row; null counts as empty."""
    begin, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= limit:
            yield begin, group
            begin, group, size = i + 1, [], 0
    if group:
        yield begin, group
