"""Benchmark passages in documents, by q-gram lemma filtering (operator 8).

A leak is a window of SEGMENT characters anywhere in an item, or the whole of an item of up to 1.5 times as many, within
its budget of k edits.
A text within k edits of a window of m characters shares at least m - q + 1 - kq q-grams with it, near one diagonal (place
in the text less place in the item). Workers look up the text's q-grams among the items', sort the hits of each item in
overlapping diagonal bands at least k wide by place, keep the windows that reach the bound, and verify those by banded
alignment with free ends in the text. Documents are only read, once and never shuffled. The benchmark's different texts come
in blocks of bounded size; all blocks are broadcast, compressed, and a worker has the tables of one block at a time.

A text that repeats a few characters over a long stretch has the same windows again and again; of such a stretch all but
two ends are left out of the search (``squeezed``), so that its length doesn't count.

Characters compare in lower case (up to U+05FF) and all ASCII white space as a space. An item of fewer than 20 characters
has no budget; one of fewer than Q, which has no q-gram, is found where no letter or digit of the text goes on with it.

Defined cases: a null or empty text or item has no leaks, neither has an item of blanks; null ids are
kept; repeated rows are reported each; empty tables give an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import M1, U64, ship, text_groups

#: q-grams (their hash is put together for this Q), characters of a window, and edits allowed for each character.
Q, SEGMENT, RATE = 10, 80, 0.06
#: Characters of the items in one block, and blocks that one scan of the documents takes.
BLOCK_CHARS, SCAN_BLOCKS = 8 << 20, 64
#: Periods of stretches that are squeezed, and characters that stay at each end: more than any window with its edits and band.
PERIODS, STAY = 128, 256

_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[: 0x600] = [ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x600)]
_FOLD[9:14] = 32
_POWERS = {k: U64(pow(0x9FB21C651E98DF25, k, 1 << 64)) for k in (1, 2, 4)}
#: Bits of a hash in the bitmap that most q-grams of a text end at.
MAYBE_BITS = 22


def folded(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def qgrams(chars: np.ndarray) -> np.ndarray:
    """Polynomial hash of the q-gram at each place, put together from those of 2, 4 and 8 characters."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    one = chars.astype(U64)
    two = one[:-1] * _POWERS[1] + one[1:]
    four = two[:-2] * _POWERS[2] + two[2:]
    total = four[:n] * _POWERS[4] + four[4 : 4 + n]
    return total * _POWERS[2] + two[8 : 8 + n]


def _slot(grams: np.ndarray) -> np.ndarray:
    """Place of a hash in the bitmap: the high bits of a product."""
    return (grams * M1) >> U64(64 - MAYBE_BITS)


@dataclass
class Items:
    """Patterns of one block of items, each with its item, and their q-grams in order of hash."""

    ids: list[int | None]
    item: np.ndarray
    chars: list[np.ndarray]
    window: np.ndarray
    budget: np.ndarray
    least: np.ndarray

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, first entry and number of entries of each; pattern and place of each entry."""
        grams = [qgrams(c) for c in self.chars]
        key = np.concatenate([np.zeros(0, U64), *grams])
        pattern = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(key, kind="stable")
        distinct, first, count = np.unique(key[order], return_index=True, return_counts=True)
        return distinct, first, count, pattern[order], place[order]

    @cached_property
    def maybe(self) -> np.ndarray:
        """A bitmap over the hashes: most q-grams of a text end here."""
        bits = np.zeros(1 << MAYBE_BITS, bool)
        bits[_slot(self.table[0])] = True
        return bits


    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of q-grams that the items have."""
        at = np.flatnonzero(self.maybe[_slot(grams)])
        distinct = self.table[0]
        slot = np.minimum(np.searchsorted(distinct, grams[at]), len(distinct) - 1)
        return at[distinct[slot] == grams[at]] if len(at) and len(distinct) else at[:0]

    @cached_property
    def tiny(self) -> dict[int, dict[bytes, list[int]]]:
        """Patterns without a q-gram by their length and characters."""
        out: dict[int, dict[bytes, list[int]]] = {}
        for i, c in enumerate(self.chars):
            if len(c) < Q:
                out.setdefault(len(c), {}).setdefault(c.tobytes(), []).append(i)
        return out


def block_of(rows: list[tuple[int | None, str | None]]) -> Items:
    ids, item, chars, sizes = [], [], [], []
    for doc, text in rows:
        whole = folded(text or "")
        n = len(whole)
        if not (whole != 32).any():
            continue
        for size in {min(n, SEGMENT), n if n <= 1.5 * SEGMENT else SEGMENT}:
            item.append(len(ids))
            chars.append(whole)
            sizes.append(size)
        ids.append(doc)
    window = np.array(sizes, np.int64)
    # A window that its edits may leave without a q-gram can't be found by one.
    budget = np.maximum(0, np.minimum((window * RATE).astype(np.int64), (window - Q) // Q))
    return Items(ids, np.array(item, np.int64), chars, window, budget, window - Q + 1 - budget * Q)


def banded_alignments(patterns: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each row of ``patterns`` against any part of ``text`` along ``width`` diagonals from its ``low`` on
    (text less pattern), and start and end in the text; edits above the budget are budget + 1."""
    far = budget + 1
    diagonals = low[:, None] + np.arange(width)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    start = diagonals.copy()
    step = np.arange(width)
    right = np.full((len(patterns), 1), far)
    for i in range(patterns.shape[1]):
        at = diagonals + i
        ok = (at >= 0) & (at < len(text))
        same = ok & (text[np.where(ok, at, 0)] == patterns[:, i : i + 1])
        # Along the diagonal, or a pattern character without one in the text (from the next diagonal).
        new = np.where(ok, cost + ~same, far)
        gap = np.concatenate([cost[:, 1:] + 1, right], axis=1)
        gap[(at + 1 < 0) | (at + 1 > len(text))] = far
        better = gap < new
        new, origin = np.where(better, gap, new), np.where(better, np.concatenate([start[:, 1:], 0 * right], axis=1), start)
        # Text characters without one in the pattern: a running minimum along the band.
        low_cost = np.minimum.accumulate(new - step, axis=1)
        source = np.maximum.accumulate(np.where(new - step == low_cost, step, 0), axis=1)
        cost, start = low_cost + step, np.take_along_axis(origin, source, axis=1)
        if cost.min(initial=far) > budget:
            break
    ends = diagonals + patterns.shape[1]
    cost = np.minimum(np.where((ends >= 0) & (ends <= len(text)), cost, far), far)
    k, rows = cost.argmin(axis=1), np.arange(len(patterns))
    return cost[rows, k], start[rows, k], ends[rows, k]


def banded_alignment(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of one pattern along diagonals low..high, or None above the budget."""
    edits, start, end = (int(x[0]) for x in banded_alignments(pattern[None], text, np.array([low]), high - low + 1, budget))
    return (edits, start, end) if edits <= budget else None


def _candidates(chars: np.ndarray, items: Items) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pattern, band, diagonals of its hits, and which windows of the pattern reach the bound of q-grams in the band."""
    distinct, first, count, pattern, place = items.table
    grams = qgrams(chars)
    at = np.flatnonzero(items.maybe[_slot(grams)])
    if not len(at) or not len(distinct):
        return
    slot = np.minimum(np.searchsorted(distinct, grams[at]), len(distinct) - 1)
    ok = distinct[slot] == grams[at]
    at, slot = at[ok], slot[ok]
    if not len(at):
        return
    n = count[slot]
    entry = np.repeat(first[slot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    s, p = pattern[entry], place[entry]
    diagonal = np.repeat(at, n) - p
    band = diagonal // (items.budget[s] + 1)
    s, p, diagonal, band = np.tile(s, 2), np.tile(p, 2), np.tile(diagonal, 2), np.concatenate([band, band - 1])
    order = np.lexsort((p, band, s))
    s, p, diagonal, band = s[order], p[order], diagonal[order], band[order]
    edge = (s[1:] != s[:-1]) | (band[1:] != band[:-1])
    heads = np.append(np.flatnonzero(np.append(True, edge)), len(s))
    # A text repeats a q-gram often; a place of the pattern counts once in a band.
    enough = np.add.reduceat(np.append(True, edge | (p[1:] != p[:-1])).astype(np.int64), heads[:-1]) >= items.least[s[heads[:-1]]]
    for a, b in zip(heads[:-1][enough].tolist(), heads[1:][enough].tolist(), strict=True):
        i = int(s[a])
        size, need = int(items.window[i]), int(items.least[i])
        own = np.unique(p[a:b])
        begin, end = own[: len(own) - need + 1], own[need - 1 :]
        ok = end - begin <= size - Q
        last = len(items.chars[i]) - size
        change = np.zeros(last + 2, np.int64)
        np.add.at(change, np.maximum(0, end[ok] - (size - Q)), 1)
        np.add.at(change, np.minimum(begin[ok], last) + 1, -1)
        if (wanted := np.cumsum(change)[:-1] > 0).any():
            yield i, int(band[a]), np.unique(diagonal[a:b]), wanted


def _exact(pattern: np.ndarray, chars: np.ndarray, diagonal: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``size`` characters of the pattern that the text has along a diagonal."""
    a, b = max(0, -diagonal), min(len(pattern), len(chars) - diagonal)
    if b - a >= size:
        same = np.concatenate([[False], pattern[a:b] == chars[a + diagonal : b + diagonal], [False]])
        ends = np.flatnonzero(same[1:] != same[:-1])
        yield from ((a + x, a + y) for x, y in ends.reshape(-1, 2).tolist() if y - x >= size)


def _tiny(chars: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """Pattern, start and end of each place of a pattern that has no q-gram."""
    for m, wanted in items.tiny.items():
        if len(chars) < m:
            continue
        views = np.lib.stride_tricks.sliding_window_view(chars, m)
        starts = np.flatnonzero(np.isin(chars[: len(chars) - m + 1], [np.frombuffer(w, np.uint32)[0] for w in wanted]))
        for a in starts.tolist():
            found = wanted.get(views[a].tobytes())
            # A word that goes on is another word.
            if found and not any(chr(chars[x]).isalnum() and chr(chars[y]).isalnum() for x, y in ((a - 1, a), (a + m, a + m - 1)) if 0 <= x < len(chars)):
                yield from ((i, a, a + m) for i in found)


def squeezed(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text without the middle of stretches that repeat up to PERIODS characters, and the place of each character left.

    What goes is a multiple of the period, so the windows of what stays are those of the whole.
    """
    origin = np.arange(len(chars))
    for p in range(1, PERIODS + 1):
        if len(chars) < 3 * STAY:
            break
        same = np.concatenate([[False], chars[p:] == chars[:-p], [False]])
        ends = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        keep = None
        for a, b in ends[ends[:, 1] - ends[:, 0] >= 2 * STAY + p].tolist():
            keep = np.ones(len(chars), bool) if keep is None else keep
            keep[a + STAY : a + STAY + (b + p - a - 2 * STAY) // p * p] = False
        if keep is not None:
            chars, origin = chars[keep], origin[keep]
    return chars, origin


def find(text: str, items: Items) -> list[tuple[int | None, int, int, int, int]]:
    """Leaks in one text: item id, start, end, fewest edits of a window and characters of the item found, one row for each place."""
    chars = folded(text)
    if not items.chars or not len(chars):
        return []
    hits = items.hits(qgrams(chars))
    if not items.tiny and not len(hits):
        return []
    # A stretch that repeats and could be squeezed has that many hits, or none to search.
    chars, origin = squeezed(chars) if len(hits) >= STAY else (chars, np.arange(len(chars)))
    return [(item, int(origin[a]), int(origin[b - 1]) + 1 if b > a else int(origin[a]), edits, n) for item, a, b, edits, n in _places(chars, items)]


def _places(chars: np.ndarray, items: Items) -> list[tuple[int | None, int, int, int, int]]:
    #: By item: start, end and edits in the text, first and last place in the item.
    found: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for i, a, b in _tiny(chars, items):
        found.setdefault(int(items.item[i]), []).append((a, b, 0, 0, b - a))
    before = None
    for i, band, diagonals, wanted in _candidates(chars, items) if len(chars) >= Q else ():
        pattern, size, k = items.chars[i], int(items.window[i]), int(items.budget[i])
        rows = found.setdefault(int(items.item[i]), [])
        # No edits at all need no alignment; the next band, which overlaps this one, often holds the same.
        have = np.zeros(len(wanted), bool)
        seen = before[2] if before and before[:2] == (i, band - 1) else have
        for d in diagonals.tolist():
            for a, b in _exact(pattern, chars, d, size):
                rows.append((a + d, b + d, 0, a, b))
                have[a : b - size + 1] = True
        low, width = band * (k + 1) - k, 2 * (k + 1) + 2 * k
        open_ = np.flatnonzero(wanted & ~have & ~seen)
        for begin in range(0, len(open_), 512):
            starts = open_[begin : begin + 512]
            edits, start, end = banded_alignments(pattern[starts[:, None] + np.arange(size)], chars, starts + low, width, k)
            ok = edits <= k
            have[starts[ok]] = True
            rows += zip(start[ok].tolist(), end[ok].tolist(), edits[ok].tolist(), starts[ok].tolist(), (starts[ok] + size).tolist(), strict=True)
        before = (i, band, have)
    out = []
    for i, rows in sorted(found.items()):
        group: list[tuple[int, int, int, int, int]] = []
        reach = 0
        for r in [*sorted(rows), None]:
            if group and (r is None or r[0] > reach):
                covered = np.zeros(max(x[4] for x in group), bool)
                for *_, a, b in group:
                    covered[a:b] = True
                out.append((items.ids[i], group[0][0], reach, min(x[2] for x in group), int(covered.sum())))
                group = []
            if r is not None:
                reach = max(reach, r[1]) if group else r[1]
                group.append(r)
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[Broadcast]]:
    """The different texts of the benchmark in broadcast blocks of about ``block_chars`` characters, those of one scan together.
    A block is a name and its compressed rows: the text's hash, which stands for all items that have it, and the text."""
    spark = benchmark.sparkSession
    texts = benchmark.select(F.col(text_col).alias("text")).where("text is not null").distinct().select(_key(F.col("text")).alias("key"), "text")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    n, held = -(-size // block_chars), []
    for k in range(n):
        part = texts.where(F.pmod("key", F.lit(n)) == k).orderBy("key", "text").collect()
        rows = zstandard.ZstdCompressor().compress(pickle.dumps([tuple(r) for r in part]))
        held.append(spark.sparkContext.broadcast((uuid.uuid4().hex, rows)))
        if len(held) == SCAN_BLOCKS or k == n - 1:
            yield held
            held = []


def _key(text: Column) -> Column:
    return F.xxhash64(F.lit(7), text)


_LOADED: dict[str, Items] = {}


def loaded(block: Broadcast) -> Items:
    """A block's items and tables; the worker keeps those of the last one."""
    name, rows = block.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = block_of(pickle.loads(zstandard.ZstdDecompressor().decompress(rows)))
    return _LOADED[name]


HITS = "doc_id long, item_id long, start long, end long, edits long, item_chars long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document, item and place where it is found; clean documents have none."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = HITS.replace("item_id", "key")
    out = spark.createDataFrame([], hits)
    for held in blocks(benchmark, item_col, item_text_col, block_chars):

        def search(batches: Iterator[pa.RecordBatch], held: list[Broadcast] = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for block in held:
                    for begin, group in text_groups(batch.column(1).to_pylist()):
                        found = [(ids[i], *hit) for i, text in enumerate(group, begin) for hit in find(text, loaded(block))]
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[c.split()[0] for c in hits.split(", ")])

        out = out.unionByName(rows.mapInArrow(search, hits))
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(_key(F.col(item_text_col)).alias("key"), F.col(item_col).cast("long").alias("item_id"))
    return out.join(items, "key").select(*[c.split()[0] for c in HITS.split(", ")])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without a benchmark passage, all columns as they are."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index(text_col), docs.schema
    for held in blocks(benchmark, item_col, item_text_col, block_chars):

        def clean(batches: Iterator[pa.RecordBatch], held: list[Broadcast] = held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                stays = np.ones(len(texts), bool)
                for block in held:
                    stays &= [not (stay and find(text or "", loaded(block))) for stay, text in zip(stays, texts, strict=True)]
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(clean, schema)
    return docs
