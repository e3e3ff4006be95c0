"""Token ids of whole texts from a tokenizer file, fast on texts that repeat their words.

The ``tokenizers`` library makes all ids. Where its file describes a byte-level BPE that
splits by the usual pattern, a text falls apart wherever white space follows other text and where a mark follows a
letter, and the ids of such a piece don't depend on its neighbours. Each worker remembers pieces in a hash table of
arrays: a piece of up to 32 bytes is its own key, so what the table finds is the same piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from taxaloom.llm.common import M1, U64, text_bytes

#: Characters that the splitting patterns of libraries class differently, or white space beyond ASCII.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
WHITE = b" \t\n\r\x0b\x0c"
#: Marks before which a piece ends if a letter precedes; the apostrophe may go on with the letters after it.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text handled at once, and pieces encoded as one text.
BLOCK, TOGETHER = 1 << 20, 2048
#: Pieces remembered before the worker starts anew, slots of its table, and bytes of the longest piece in it.
REMEMBERED, SLOT_BITS, LONGEST = 1_000_000, 22, 32

# Classes of bytes: white space, letters of ASCII, first bytes of two-byte letters (U+00C0 to U+023F), marks, and first bytes of UNSURE.
_WHITE, _LETTER, _LEAD, _MARK, _UNSURE = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(WHITE)] = _WHITE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[0xC3:0xC9] = _LEAD
_CLASS[list(MARKS)] = _MARK
_CLASS[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _UNSURE
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)

_ENCODERS: dict[str, Encoder] = {}


class Column:
    """A growing array."""

    def __init__(self, dtype: np.dtype) -> None:
        self.held, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(need, len(self.held)), self.held.dtype)])
        self.held[self.n : need] = values
        self.n = need


class Pieces:
    """Known pieces: four words of bytes, length, and where their ids are."""

    def __init__(self, dtype: np.dtype) -> None:
        self.table = np.full(1 << SLOT_BITS, -1, np.int32)
        self.words = [Column(U64) for _ in _KEYS]
        self.length, self.first, self.count, self.ids = Column(np.uint8), Column(np.int64), Column(np.int64), Column(dtype)

    def __len__(self) -> int:
        return self.first.n

    def add(self, ids: list[bytes], words: list[np.ndarray], length: np.ndarray) -> np.ndarray:
        """New entries and their numbers; the table doesn't lead to them yet."""
        size = self.ids.held.itemsize
        count = np.array([len(x) // size for x in ids], np.int64)
        begin = len(self)
        self.first.add(self.ids.n + np.cumsum(count) - count)
        self.count.add(count)
        self.ids.add(np.frombuffer(b"".join(ids), self.ids.held.dtype))
        self.length.add(length)
        for column, values in zip(self.words, words, strict=True):
            column.add(values)
        return np.arange(begin, begin + len(ids), dtype=np.int32)

    def place(self, entry: np.ndarray, slot: np.ndarray) -> None:
        while len(entry):
            free = self.table[slot] < 0
            self.table[slot[free]] = entry[free]
            left = self.table[slot] != entry
            entry, slot = entry[left], slot[left] + 1 & len(self.table) - 1

    def look(self, words: list[np.ndarray], length: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 if it is new."""
        out = np.full(len(slot), -1, np.int32)
        open_ = np.arange(len(slot))
        while len(open_):
            entry = self.table[slot]
            taken = entry >= 0
            open_, slot, entry = open_[taken], slot[taken], entry[taken]
            same = (self.words[0].held[entry] == words[0][open_]) & (self.length.held[entry] == length[open_])
            more = np.flatnonzero(same & (length[open_] > 8))
            for k in range(1, len(words)):
                same[more] &= self.words[k].held[entry[more]] == words[k][open_[more]]
            out[open_[same]] = entry[same]
            open_, slot = open_[~same], slot[~same] + 1 & len(self.table) - 1
        return out


class Encoder:
    def __init__(self, tokenizer_json: str) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("truncation")
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.known = Pieces(self.dtype)
        # In a byte-level vocabulary each character of a token stands for a byte.
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        if self.by_piece:
            for token, i in self.tokenizer.get_vocab().items():
                self.lengths[i] = len(token)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces from the ids of their joined text, cut where a piece's bytes end."""
        ids = np.frombuffer(self._ids([b"".join(pieces)])[0], self.dtype)
        ends = np.cumsum([len(p) for p in pieces])
        at = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        raw, bounds = ids.tobytes(), (at * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces. Most start with white space and end without: many of them make one text."""
        out = [b""] * len(pieces)
        inner = [i for i, p in enumerate(pieces) if p[0] in WHITE and p[-1] not in WHITE and len(p) < BLOCK]
        for k in range(0, len(inner), TOGETHER):
            part = inner[k : k + TOGETHER]
            for i, ids in zip(part, self._together([pieces[i] for i in part]), strict=True):
                out[i] = ids
        joined = set(inner)
        rest = [i for i in range(len(pieces)) if i not in joined]
        for i, ids in zip(rest, self._ids([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _whole_rows(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows whose text can't be cut."""
        if not self.by_piece:
            return np.arange(len(at) - 1)
        found = set()
        unsure = np.concatenate([np.flatnonzero(_CLASS[raw[k : k + BLOCK]] == _UNSURE) + k for k in range(0, len(raw), BLOCK)] or [np.zeros(0, np.int64)])
        for r in np.unique(np.searchsorted(at, unsure, "right") - 1).tolist():
            if UNSURE.search(raw[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")):
                found.add(r)
        text = raw.tobytes()
        for s in self.special:
            i = text.find(s)
            while i >= 0:
                found.add(int(np.searchsorted(at, i, "right")) - 1)
                i = text.find(s, i + 1)
        return np.array(sorted(found), np.int64)

    def _starts(self, raw: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each piece in order, and which of them are whole rows."""
        found = []
        for k in range(0, len(raw), BLOCK):
            low = max(0, k - 2)
            kind = _CLASS[raw[low : k + BLOCK]]
            white = kind == _WHITE
            first = np.zeros(len(kind), bool)
            first[1:] = white[1:] & ~white[:-1]
            mark = np.flatnonzero(kind == _MARK)
            mark = mark[mark > 0]
            before = raw[mark - 1 + low]
            lead = np.where(mark > 1, kind[np.maximum(mark - 2, 0)] == _LEAD, False) & (before >= 0x80) & (before < 0xC0)
            times = (before == 0x97) | (before == 0xB7)  # the signs among those letters
            lead &= ~(times & (raw[np.maximum(mark - 2, 0) + low] == 0xC3))
            first[mark] = (kind[mark - 1] == _LETTER) | lead
            begins = at[np.searchsorted(at, k) : np.searchsorted(at, k + BLOCK)] - low
            first[begins[begins < len(first)]] = True
            found.append(np.flatnonzero(first[k - low :]) + k)
        starts = np.concatenate(found or [np.zeros(0, np.int64)])
        if not len(whole):
            return starts, np.zeros(len(starts), bool)
        row = np.searchsorted(at, starts, "right") - 1
        is_whole = np.isin(row, whole)
        keep = ~is_whole | (starts == at[row])
        return starts[keep], is_whole[keep]

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Entry of each piece; unknown ones are learnt, long ones and whole rows have entries until the next start."""
        out = np.full(len(starts), -1, np.int32)
        length = ends - starts
        alone = whole | (length > LONGEST)
        short = np.flatnonzero(~alone)
        padded = np.concatenate([raw, np.zeros(LONGEST + 8, np.uint8)])
        view = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
        at, size = starts[short], length[short]
        words = [view[at] & _TAIL[np.minimum(size, 8)]]
        for k in range(1, len(_KEYS)):
            longer = np.flatnonzero(size > 8 * k)
            word = np.zeros(len(at), U64)
            word[longer] = view[at[longer] + 8 * k] & _TAIL[np.minimum(size[longer] - 8 * k, 8)]
            words.append(word)
        mixed = size.astype(U64) * M1
        for word, key in zip(words, _KEYS, strict=True):
            mixed = (mixed ^ word) * key
            mixed ^= mixed >> U64(29)
        slot = (mixed * M1 >> U64(64 - SLOT_BITS)).astype(np.int64)
        size = size.astype(np.uint8)
        entry = self.known.look(words, size, slot)
        while len(new := np.flatnonzero(entry < 0)):
            # One of those that mix alike is learnt in each round.
            new = new[np.unique(mixed[new], return_index=True)[1]]
            ids = self._ids_of([raw[a:b].tobytes() for a, b in zip(at[new].tolist(), (at[new] + size[new]).tolist(), strict=True)])
            self.known.place(self.known.add(ids, [w[new] for w in words], size[new]), slot[new])
            left = np.flatnonzero(entry < 0)
            entry[left] = self.known.look([w[left] for w in words], size[left], slot[left])
        out[short] = entry
        own = np.flatnonzero(alone)
        if len(own):
            pieces = [raw[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            different = {p: i for i, p in enumerate(dict.fromkeys(zip(pieces, whole[own].tolist(), strict=True)))}
            cut = [p for p, is_whole in different if not is_whole]
            ids = dict(zip(((p, False) for p in cut), self._ids_of(cut), strict=True))
            rows = [p for p, is_whole in different if is_whole]
            ids |= dict(zip(((p, True) for p in rows), self._ids(rows), strict=True))
            none = np.zeros(len(different), U64)
            number = self.known.add([ids[p] for p in different], [none] * len(_KEYS), none)
            out[own] = number[[different[p] for p in zip(pieces, whole[own].tolist(), strict=True)]]
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of rows: first row, all their ids, and the n + 1 offsets of the rows among these. Null counts as empty;
        a run has about BLOCK bytes, or one row."""
        raw, at = text_bytes(column)
        begin = 0
        while begin < len(column):
            stop = max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK, "right")) - 1)
            yield begin, *self._rows(raw[at[begin] : at[stop]], at[begin : stop + 1] - at[begin])
            begin = stop

    def _rows(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = Pieces(self.dtype)
        starts, whole = self._starts(raw, at, self._whole_rows(raw, at))
        ends = np.append(starts[1:], len(raw))
        parts, counts = [], []
        # A text's pieces are looked up in parts, cut anywhere between two.
        bounds = [0]
        while bounds[-1] < len(starts):
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(ends, starts[bounds[-1]] + 2 * BLOCK, "right"))))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            low = starts[a]
            entry = self._entries(raw[low : ends[b - 1]], starts[a:b] - low, ends[a:b] - low, whole[a:b])
            n = self.known.count.held[entry]
            source = np.repeat(self.known.first.held[entry] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            parts.append(self.known.ids.held[source])
            counts.append(n)
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
        ids = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, self.dtype), *parts])
        return ids, total[np.searchsorted(starts, at)]


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder for this tokenizer; it outlives the task."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_json)
    return _ENCODERS[key]
