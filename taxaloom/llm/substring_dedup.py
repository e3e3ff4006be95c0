"""Repeated passages across documents (operator 10).

A window is a run of ``window`` words. A word goes if a window that covers it also starts in a document
with a smaller id.

1. Each window has an anchor, the run of ANCHOR words in it with the least hash, so equal windows have equal
   anchors. Workers send the different anchors of their documents as packed blocks; an anchor of one document
   only can't hold a repeated window, and most are that.
2. Around the other anchors workers cut segments, the words of all windows with this anchor, and send each
   different segment once to the shard of its anchor. An anchor with very many occurrences would overload its
   shard: its windows are sent one by one to shards of their own hashes instead.
3. A shard indexes its different segments (BWT, wavelet matrix), streams the windows of these through backward
   search, and takes the smallest document of each match. What it reports are the word intervals to remove.
4. Workers read the intervals of their documents and write what is left.

Text is shuffled nowhere; steps 1, 2 and 4 read one stored copy of the documents.

Defined cases: a null or empty text has no words; fewer words than a window lose nothing; a null doc_id is neither
a source nor changed; rows that share a doc_id don't count against each other; repeated rows are each returned; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import U64, mix, ngram_hashes, shared_dir, ship, word_hashes, word_spans
from taxaloom.llm.fm_index import ORDER, FMIndex

ANCHOR = 4
#: Bytes of text for each shard and its task.
TASK_BYTES = 32 << 20
#: Occurrences from which the windows of an anchor go to shards of their own.
HOT = 4096
#: Anchors or segment words that a worker gathers before it sends a block.
BLOCK_ANCHORS, BLOCK_WORDS = 2_000_000, 5_000_000
#: Rows of one batch handled at once.
STEP = 256
#: Bits of an anchor that are compared; a chance collision only makes a segment that matches nothing.
KEY_BITS = 52
_PART = 33  # bits of a row's number below its partition's in monotonically_increasing_id


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; equal bytes of neighbouring numbers stand together."""
    planes = [(a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(planes))


def _unpack(block: bytes) -> list[np.ndarray]:
    out = []
    for kind, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(block)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel())
    return out


def _sorted_pack(keys: np.ndarray, *others: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U64(0)), *others)


def _sorted_unpack(block: bytes) -> list[np.ndarray]:
    first, *others = _unpack(block)
    return [np.cumsum(first, dtype=U64), *others]


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key, first window and number of windows of each run of windows with one anchor."""
    grams = ngram_hashes(words, ANCHOR)
    width = window - ANCHOR + 1
    if len(grams) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[starts]] >> U64(64 - KEY_BITS), starts, np.diff(np.append(starts, len(place)))


def _docs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Row, id and word hashes of each document that can have a window."""
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            part = batch.slice(k, STEP)
            hashes, at = word_hashes(part.column(2))
            rows, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
            for i in range(len(rows)):
                if ids[i] is not None and at[i + 1] - at[i] >= window:
                    yield rows[i], ids[i], hashes[at[i] : at[i + 1]]


def _table(rows: list[dict], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names.split(), kinds, strict=True))))


def _send_anchors(window: int, buckets: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        size, part = 0, None

        def block() -> Iterator[pa.RecordBatch]:
            found, counts = np.unique(np.concatenate(keys), return_counts=True)
            bucket = (mix(found) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[b] : bounds[b + 1]]
                rows.append({"bucket": b, "part": part, "block": _sorted_pack(found[own], counts[own].astype(np.uint32))})
            yield _table(rows, "bucket part block", [pa.int64(), pa.int64(), pa.binary()])

        for row, _, words in _docs(batches, window):
            if keys and (row >> _PART != part or size >= BLOCK_ANCHORS):
                yield from block()
                keys, size = [], 0
            part = row >> _PART
            keys.append(np.unique(anchors(words, window)[0]))
            size += len(keys[-1])
        if keys:
            yield from block()

    return send


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: for each partition its anchors that several documents have, and which of them are hot."""
    blocks = [_sorted_unpack(b) for b in table.column("block").to_pylist()]
    keys = np.concatenate([b[0] for b in blocks])
    found, at = np.unique(keys, return_inverse=True)
    documents = np.bincount(at, np.concatenate([b[1] for b in blocks]).astype(np.float64), len(found))
    rows, place = [], 0
    for part, (own, _) in zip(table.column("part").to_pylist(), blocks, strict=True):
        n = documents[at[place : place + len(own)]]
        place += len(own)
        if (n > 1).any():
            rows.append({"part": part, "block": _sorted_pack(own[n > 1], (n[n > 1] >= HOT).astype(np.uint8))})
    return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("block", pa.binary())]))


def _by_part(df: DataFrame, folder: str, name: str) -> str:
    """Writes blocks so that a worker finds those of a partition in a folder of its own."""
    path = f"{folder}/{name}"
    df.repartition("part").write.partitionBy("part").parquet(path)
    return path


def _blocks_of(path: str, part: int) -> list[bytes]:
    store, root = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    return [b for f in files if f.base_name.endswith(".parquet") for b in pq.read_table(f.path, columns=["block"], filesystem=store, partitioning=None).column("block").to_pylist()]


class _Segments:
    """Different segments for one shard, and where they occur."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.where: list[tuple[int, int, int, int]] = []

    def add(self, words: np.ndarray, row: int, doc: int, start: int) -> int:
        raw = words.tobytes()
        k = self.known.setdefault(raw, len(self.known))
        if k == len(self.words):
            self.words.append(words)
        self.where.append((k, row, doc, start))
        return len(words) if k == len(self.words) - 1 else 4

    def pack(self) -> bytes:
        vocabulary, codes = np.unique(np.concatenate(self.words), return_inverse=True)
        k, row, doc, start = (np.array(x, np.int64) for x in zip(*self.where, strict=True))
        near = [np.diff(x, prepend=0) for x in (row, doc)]
        return _pack(np.diff(vocabulary, prepend=U64(0)), codes.astype(np.uint32), np.array([len(w) for w in self.words], np.uint16), k.astype(np.uint32), *near, start.astype(np.uint32))


def _send_segments(path: str, window: int, shards: int) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, _Segments] = {}
        size, part, keys, hot = 0, None, np.zeros(0, U64), np.zeros(0, bool)

        def block() -> pa.RecordBatch:
            return _table([{"shard": s, "block": x.pack()} for s, x in out.items()], "shard block", [pa.int64(), pa.binary()])

        for row, doc, words in _docs(batches, window):
            if row >> _PART != part:
                part = row >> _PART
                blocks = [_sorted_unpack(b) for b in _blocks_of(path, part)]
                keys = np.concatenate([b[0] for b in blocks] or [np.zeros(0, U64)])
                order = np.argsort(keys, kind="stable")
                keys, hot = keys[order], np.concatenate([b[1] for b in blocks] or [np.zeros(0, np.uint8)])[order].astype(bool)
            if not len(keys):
                continue
            key, first, count = anchors(words, window)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            wanted = np.flatnonzero(keys[at] == key)
            shard = (mix(key[wanted]) % U64(shards)).astype(np.int64).tolist()
            each = None
            for i, s in zip(wanted.tolist(), shard, strict=True):
                a, n = int(first[i]), int(count[i])
                if not hot[at[i]]:
                    size += out.setdefault(s, _Segments()).add(words[a : a + n + window - 1], row, doc, a)
                    continue
                each = ngram_hashes(words, window) if each is None else each
                for w in range(a, a + n):
                    size += out.setdefault(int(each[w] % U64(shards)), _Segments()).add(words[w : w + window], row, doc, w)
            if size >= BLOCK_WORDS:
                yield block()
                out, size = {}, 0
        if out:
            yield block()

    return send


def _repeats(window: int) -> Callable:
    def find(table: pa.Table) -> pa.Table:
        """Of one shard: the word intervals that smaller documents have too, in blocks by partition."""
        blocks = [_unpack(b) for b in table.column("block").to_pylist()]
        vocabulary = np.unique(np.concatenate([np.cumsum(b[0], dtype=U64) for b in blocks]))
        texts, lengths, ks, rows, docs, starts, base = [], [], [], [], [], [], 0
        for words, codes, length, k, row, doc, start in blocks:
            texts.append(np.searchsorted(vocabulary, np.cumsum(words, dtype=U64))[codes] + 1)
            lengths.append(length.astype(np.int64))
            ks.append(k.astype(np.int64) + base)
            rows.append(np.cumsum(row))
            docs.append(np.cumsum(doc))
            starts.append(start.astype(np.int64))
            base += len(length)
        text, length, k, row, doc, start = map(np.concatenate, (texts, lengths, ks, rows, docs, starts))
        # Equal segments of different blocks become one, with the smallest document of all.
        ends = np.cumsum(length)
        begin = ends - length
        digest = _digests(text, begin, length)
        _, same, segment = np.unique(digest, return_index=True, return_inverse=True)
        k = segment[k]
        smallest = np.full(len(same), np.iinfo(np.int64).max)
        np.minimum.at(smallest, k, doc)
        length, begin = length[same], begin[same]
        # The text of the index: each segment, then a separator.
        at = np.cumsum(length + 1) - (length + 1)
        source = np.repeat(begin - at, length + 1) + np.arange(int((length + 1).sum()))
        body = text[np.minimum(source, len(text) - 1)]
        body[at + length] = 0
        index = FMIndex(body.astype(np.int64), len(vocabulary) + 1)
        owner = np.repeat(np.arange(len(length)), length + 1)
        windows = np.flatnonzero(np.arange(len(body)) - at[owner] <= (length - window)[owner])
        lo, hi = index.matches(windows, window)
        # Smallest document of each match; a match alone is the segment itself.
        first = smallest[owner[windows]].copy()
        several = np.flatnonzero(hi - lo > 1)
        if len(several):
            value = smallest[owner[index.order]]
            spans, which = np.unique(lo[several], return_inverse=True)
            stops = np.empty(len(spans), np.int64)
            stops[which] = hi[several]
            low = np.minimum.reduceat(np.append(value, np.iinfo(np.int64).max), np.stack([spans, stops], 1).ravel())[::2]
            first[several] = low[which]
        # Back to the occurrences: all windows of a segment, against its document.
        per = length - window + 1
        offset = np.cumsum(per) - per
        n = per[k]
        which = np.repeat(np.arange(len(k)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = first[offset[k][which] + inside] < doc[which]
        which, inside = which[hit], inside[hit]
        row, a = row[which], start[which] + inside
        order = np.lexsort((a, row))
        row, a = row[order], a[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] > a[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(row))[: len(heads)] - 1
        row, a, b = row[heads], a[heads], a[tails] + window
        out = []
        parts = row >> _PART
        for part in np.unique(parts).tolist():
            own = parts == part
            out.append({"part": part, "block": _pack(row[own], a[own].astype(np.uint32), b[own].astype(np.uint32))})
        return pa.Table.from_pylist(out, schema=pa.schema([("part", pa.int64()), ("block", pa.binary())]))

    return find


def _digests(text: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each segment."""
    place = np.arange(len(text)) - np.repeat(begin, length)
    out = np.empty(len(begin), [("a", np.uint64), ("b", np.uint64)])
    for field, seed in (("a", 1), ("b", 7919)):
        each = mix(text.astype(U64) * U64(0x9E3779B97F4A7C15) + place.astype(U64) * U64(0xD1342543DE82EF95) + U64(seed))
        out[field] = mix(np.add.reduceat(each, begin) + length.astype(U64))
    return out


def _removed(path: str) -> Callable[[int], dict[int, list[tuple[int, int]]]]:
    """Looks up the intervals of a partition's rows; keeps the last partition asked for."""
    held: dict[str, object] = {"part": None}

    def of(part: int) -> dict[int, list[tuple[int, int]]]:
        if held["part"] != part:
            found: dict[int, list[tuple[int, int]]] = {}
            for row, a, b in map(_unpack, _blocks_of(path, part)):
                for r, s, e in zip(row.tolist(), a.tolist(), b.tolist(), strict=True):
                    found.setdefault(r, []).append((s, e))
            held.update(part=part, found=found)
        return held["found"]

    return of


class Repeats:
    """Documents with their repeated word intervals found; see ``find_repeats``."""

    def __init__(self, docs: DataFrame, path: str) -> None:
        self.docs, self.path = docs, path

    def intervals(self) -> DataFrame:
        """doc_id, start, stop: merged word intervals to remove (stop is exclusive)."""
        return self._map(lambda doc, raw, begins, ends, gone: [(doc, s, e) for s, e in _runs(gone)], "doc_id long, start long, stop long")

    def digests(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space."""
        return self._kept(text=False)

    def kept(self) -> DataFrame:
        """The same with the kept text."""
        return self._kept(text=True)

    def _kept(self, text: bool) -> DataFrame:
        def row(doc: int, raw: bytes, begins: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> list[tuple]:
            stay = np.flatnonzero(~gone).tolist()
            kept = b" ".join([raw[begins[i] : ends[i]] for i in stay])
            return [(doc, len(gone), len(gone) - len(stay), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] * text))]

        return self._map(row, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text)

    def _map(self, make: Callable, schema: str) -> DataFrame:
        path = self.path
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = _removed(path)
            for batch in batches:
                for k in range(0, batch.num_rows, STEP):
                    part = batch.slice(k, STEP)
                    _, begins, ends, at, raw = word_spans(part.column(2))
                    raw, out = raw.tobytes(), []
                    begins, ends = begins.tolist(), ends.tolist()
                    for i, (row, doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                        gone = np.zeros(at[i + 1] - at[i], bool)
                        for s, e in lookup(row >> _PART).get(row, ()):
                            gone[s:e] = True
                        out += make(doc, raw, begins[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], gone)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        return self.docs.mapInArrow(run, schema)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def find_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Finds the intervals of all documents; ``window`` is 8 to ORDER words."""
    if not 8 <= window <= ORDER:
        raise ValueError(f"window must be 8 to {ORDER} words")
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "repeats")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.octet_length(text_col).alias("n_bytes"))
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(f"{folder}/docs")
    kept = spark.read.schema("row long, doc_id long, text string").parquet(f"{folder}/docs")
    # The number of shards follows the input, so their size doesn't.
    total = spark.read.schema("n_bytes int").parquet(f"{folder}/docs").agg(F.sum(F.col("n_bytes").cast("long"))).first()[0] or 0
    tasks = -(-total // TASK_BYTES) or 1
    blocks = kept.mapInArrow(_send_anchors(window, tasks), "bucket long, part long, block binary").withColumn("bucket", F.col("bucket").cast("int")).repartitionById(tasks, F.col("bucket"))
    shared = _by_part(blocks.groupBy("bucket").applyInArrow(_shared_anchors, "part long, block binary"), folder, "shared")
    segments = kept.mapInArrow(_send_segments(shared, window, tasks), "shard long, block binary").withColumn("shard", F.col("shard").cast("int")).repartitionById(tasks, F.col("shard"))
    found = _by_part(segments.groupBy("shard").applyInArrow(_repeats(window), "part long, block binary"), folder, "intervals")
    return Repeats(kept, found)
