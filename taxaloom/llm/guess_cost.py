"""How many guesses a cracker needs for a value, by its cheapest segmentation.

A value is cut into words (by rank), dates, repeats of a unit of any length, keyboard walks, ascending sequences and brute-force spans. Each has a price,
log10 of its guesses, and every further segment costs one more. A dynamic program over the ends of segments finds the minimum. Words and
dates are offered one by one. Repeats, walks and sequences are stretches inside which a segment may start almost anywhere; of these starts only those can be
best that lie at the stretch's first places or follow a word, a date or another stretch: moving a start to the left costs less than the brute-force letters it
saves, and two segments of one stretch cost more than one. Of the starts that are left, one that another outdoes for good is dropped. So the time
follows the length, and the result is the minimum over all segmentations.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import numpy as np

# Passwords and words that crackers try first, most frequent first.
COMMON = """password qwerty admin letmein welcome login monkey dragon master shadow sunshine princess football
baseball superman batman trustno iloveyou starwars whatever freedom secret summer winter spring autumn hello charlie
hunter soccer hockey killer george michael jordan harley ranger jennifer thomas robert daniel andrew joshua pepper ginger
cheese coffee banana orange purple silver golden flower computer internet service access default guest root test changeme
example sample temp demo user pass key token api the and for you with this that from have will""".split()
#: Rows of a keyboard, for walks.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$57!", "aaeiossti")
YEARS = 130

_PLACE = {c: (r, i + r / 2) for r, row in enumerate(KEY_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:\d{4}[-/._]?\d{1,2}[-/._]?\d{1,2}|\d{1,2}[-/._]?\d{1,2}[-/._]?(?:\d{4}|\d{2}))", re.A)
_DIGITS = frozenset("0123456789")
SHORTEST_WORD, _LONGEST_DATE = 3, 10
#: Prices of a walk: each second key, each change between capitals and others, and having capitals.
_TURN, _SHIFT, _CAPITALS = math.log10(4) / 2, 0.5, 0.3


def lowered(value: str) -> str:
    """Lower case, character by character."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in value)


def char_cost(value: str) -> float:
    """log10 of the alphabet that the value is written in: the classes of characters it has."""
    classes = {26 + (c.isupper() * 0.5) if c.isalpha() else 10 if c in _DIGITS else 33 for c in value}
    return math.log10(sum(map(int, classes)) or 1)


def near_keys(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _case_cost(word: str) -> float:
    """log10 of the ways to write the capitals of a word."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if word[0].isupper() and upper == 1 or upper == len(word):
        return math.log10(2)
    return _log_ways(len(word), min(upper, len(word) - upper) + 1)


def _log_ways(n: int, most: int) -> float:
    """log10 of the choices of 1 to ``most`` of n places."""
    return math.log10(sum(math.comb(n, k) for k in range(1, most + 1))) if n <= 1000 else n * math.log10(2)


def word_cost(word: str, rank: int, written: str) -> float:
    """log10 of the guesses for a word of this rank, given how it is written."""
    return math.log10(rank + 1) + _case_cost(written) + (0.0 if word == lowered(written) else math.log10(4))


def date_cost(text: str) -> float | None:
    if len(text) == 4 and text[:2] in ("19", "20") and _DIGITS.issuperset(text):
        return math.log10(YEARS)
    return math.log10(365 * YEARS) + (0.0 if _DIGITS.issuperset(text) else 0.6) if _DATE.fullmatch(text) else None


def repeat_cost(times: int, size: int, each: float) -> float:
    return size * each + math.log10(times)


def walk_cost(length: int, changes: int, capitals: bool) -> float:
    """A walk of so many keys, with so many changes between capitals and others."""
    return math.log10(47 * length) + (length - 1) // 2 * _TURN + changes * _SHIFT + capitals * _CAPITALS


def sequence_cost(length: int, each: float) -> float:
    return each + math.log10(length) + 0.3


_RANKS = {w: i for i, w in enumerate(COMMON, 1)}


def words_in(value: str, low: str, ranks: Mapping[str, int]) -> dict[int, list[tuple[int, float]]]:
    """By end: start and cost of each word in a value, as it is or with signs for letters."""
    every = {w: min(r, _RANKS.get(w, r)) for w, r in ranks.items()}
    every |= {w: r for w, r in _RANKS.items() if w not in every}
    lengths: dict[str, set[int]] = {}
    for w in every:
        lengths.setdefault(w[:SHORTEST_WORD], set()).add(len(w))
    found: dict[int, list[tuple[int, float]]] = {}
    for form in {low, low.translate(LEET)}:
        for a in range(len(form) - SHORTEST_WORD + 1):
            for size in lengths.get(form[a : a + SHORTEST_WORD], ()):
                if a + size <= len(form) and (rank := every.get(form[a : a + size])):
                    found.setdefault(a + size, []).append((a, word_cost(form[a : a + size], rank, value[a : a + size])))
    return found


def _equal(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How far x agrees from a and from b on, forward (step 1) or backward from the places before (step -1)."""
    k, size = 0, 16
    while True:
        if step > 0:
            m = min(size, len(x) - b - k)
            unlike = np.flatnonzero(x[a + k : a + k + m] != x[b + k : b + k + m])
        else:
            m = min(size, a - k)
            unlike = np.flatnonzero(x[a - k - m : a - k][::-1] != x[b - k - m : b - k][::-1])
        if len(unlike):
            return k + int(unlike[0])
        k += m
        if m < size:
            return k
        size *= 2


def repetitions(value: str) -> list[tuple[int, int, int]]:
    """All maximal stretches (start, end, period) of two periods or more, each with its smallest period.

    Short periods are compared shift by shift. A stretch of a long period p holds two places p apart that are multiples of p, and agrees on four letters after or
    before them; such pairs are found all at once and then followed to both sides.
    """
    x = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out, extents = len(x), [], {}
    cover, reach = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def keep(i: int, j: int, p: int) -> None:
        if any(p % q == 0 for q in extents.get((i, j), ())):
            return
        extents.setdefault((i, j), []).append(p)
        out.append((i, j, p))
        free = cover[i:j] == 0
        cover[i:j][free], reach[i:j][free] = p, j

    for p in range(1, min(8, n // 2 + 1)):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], x[p:] == x[:-p], [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= p:
                keep(a, b + p, p)
    if n < 16:
        return out
    four = x[: n - 3].astype(np.uint64)
    for k in range(1, 4):
        four = four * np.uint64(0x9E3779B97F4A7C15) + x[k : n - 3 + k]
    low = 8
    while low <= n // 2:
        periods = np.arange(low, min(2 * low, n // 2 + 1))
        counts = (n - 1 - periods) // periods + 1
        p = np.repeat(periods, counts)
        q = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
        ahead = np.flatnonzero(q + p + 4 <= n)
        behind = np.flatnonzero(q >= 4)
        alike = np.zeros(len(p), bool)
        alike[ahead] = four[q[ahead]] == four[q[ahead] + p[ahead]]
        alike[behind] |= four[q[behind] - 4] == four[q[behind] + p[behind] - 4]
        p, q = p[alike], q[alike]
        fresh = ~((cover[q] > 0) & (q + p < reach[q]) & (p % np.maximum(cover[q], 1) == 0))
        for a, size in zip(q[fresh].tolist(), p[fresh].tolist(), strict=True):
            if cover[a] and a + size < reach[a] and size % cover[a] == 0:
                continue
            after, before = _equal(x, a, a + size, 1), _equal(x, a, a + size, -1)
            if after + before >= size:
                keep(a - before, a + size + after, size)
        low *= 2
    return out


def guess_cost(value: str, ranks: Mapping[str, int]) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for ``value`` by its cheapest segmentation, and the segments (kind, start, end)."""
    n, low, each = len(value), lowered(value), char_cost(value)
    words = words_in(value, low, ranks)
    best, back = [0.0] + [math.inf] * n, [("", 0, -1)] * (n + 1)
    further = [0.0] + [1.0] * n

    def offer(a: int, b: int, cost: float, kind: str, tag: int = -1) -> None:
        cost += best[a] + further[a]
        if cost < best[b]:
            best[b], back[b] = cost, (kind, a, tag)

    def may_start(a: int, first: int, period: int, tag: int) -> bool:
        """Whether a segment of the stretch that begins at ``first`` may be best from a on."""
        kind, since, own = back[a]
        return not (kind == "brute" and a - period >= max(first, since) or own == tag and a > 0)

    def put(starts: list[tuple[int, float]], a: int) -> None:
        """A start that is cheaper than earlier ones outdoes them: its segments are shorter."""
        base = best[a] + further[a]
        while starts and starts[-1][1] >= base:
            starts.pop()
        starts.append((a, base))

    def offer_all(starts: list[tuple[int, float]], b: int, price: float, period: int, kind: str, tag: int) -> None:
        """Segments from all starts, priced and log10 of the times; a later start that an earlier one outdoes now is outdone for good."""
        kept, least = [], math.inf
        for a, base in starts:
            cost = base + price + math.log10((b - a) // period)
            if cost < least:
                least = cost
                kept.append((a, base))
                if cost < best[b]:
                    best[b], back[b] = cost, (kind, a, tag)
        starts[:] = kept

    stretches = sorted((i + max(2 * p, 3), i, j, p) for i, j, p in repetitions(value) if j - i >= 3)
    active: list[tuple[int, int, int, int, dict]] = []
    coming = 0
    changes, capitals = [0] * (n + 1), [0] * (n + 1)  # up to a character: changes between capitals and others, and capitals
    for k, c in enumerate(value):
        capitals[k + 1] = capitals[k] + c.isupper()
        changes[k + 1] = changes[k] + (k > 0 and c.isupper() != value[k - 1].isupper())
    brute, since = math.inf, 0
    walk_from = sequence_from = 0
    walks: list[tuple[int, float]] = []
    sequences: list[tuple[int, float]] = []
    tags = len(stretches)
    walk_tag, sequence_tag = tags, tags + 1
    for b in range(1, n + 1):
        c = value[b - 1]
        open_ = best[b - 1] + further[b - 1]
        if brute <= open_:
            brute += each
        else:
            brute, since = open_ + each, b - 1
        best[b], back[b] = brute, ("brute", since, -1)
        for a, cost in words.get(b, ()):
            offer(a, b, cost, "word")
        if c in _DIGITS:
            for a in range(max(0, b - _LONGEST_DATE), b - 3):
                if (cost := date_cost(value[a:b])) is not None:
                    offer(a, b, cost, "date")
        if b > 1:
            if not (c.isalnum() and value[b - 2].isalnum() and ord(c) - ord(value[b - 2]) == 1):
                sequence_from, sequences, tags = b - 1, [], tags + 2
                sequence_tag = tags + 1
            if not near_keys(low[b - 2], low[b - 1]):
                walk_from, walks, tags = b - 1, [], tags + 2
                walk_tag = tags
        if b - 3 >= sequence_from and c.isalnum():
            if may_start(b - 3, sequence_from, 1, sequence_tag):
                put(sequences, b - 3)
            offer_all(sequences, b, each + 0.3, 1, "walk", sequence_tag)
        if b - 3 >= walk_from:
            if may_start(b - 3, walk_from, 1, walk_tag):
                base = best[b - 3] + further[b - 3]
                while walks and base <= walks[-1][1] + (b - 3 - walks[-1][0] - 1) * _TURN / 2 - 1e-9:
                    walks.pop()
                walks.append((b - 3, base))
            kept, least = [], math.inf
            for a, base in walks:
                cost = base + walk_cost(b - a, changes[b] - changes[a + 1], capitals[b] > capitals[a])
                if cost < least + _TURN + 1e-9:
                    kept.append((a, base))
                least = min(least, cost)
                if cost < best[b]:
                    best[b], back[b] = cost, ("walk", a, walk_tag)
            walks = kept
        while coming < len(stretches) and stretches[coming][0] == b:
            active.append((*stretches[coming][1:], coming, {}))
            coming += 1
        if active:
            for i, _, p, tag, starts in active:
                a = b - max(2 * p, 3)
                own = starts.setdefault(b % p, [])
                if may_start(a, i, p, tag):
                    put(own, a)
                offer_all(own, b, p * each, p, "repeat", tag)
            active = [x for x in active if x[1] > b]
    segments: list[tuple[str, int, int]] = []
    b = n
    while b:
        kind, a, _ = back[b]
        segments.append((kind, a, b))
        b = a
    return best[n], segments[::-1]
