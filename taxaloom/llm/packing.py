"""Packing token pieces into sequences of a fixed length (operator 5).

1. Spark tokenizes each document, cuts what is longer than a sequence and keeps of each piece its length,
   checksum, the writing partition and its rank among the pieces of its length there.
2. The length histogram (at most ``capacity`` counts) reaches the driver. A configuration linear program
   over it, the fewest sequences that hold all pieces, is solved by multiplicative weights: a length's price is its share of
   a sequence, and falls as its demand is covered. In each round a knapsack dynamic program gives for every length the
   configuration worth most among those that hold it; those that are full (or, in a second try, worth almost as much as the
   best) run until their scarcest length has had its step, rounded down to whole sequences. Rounds go
   on until none is left to take; what then remains, a number of pieces that follows the lengths and not the
   input, goes to best-fit decreasing. The try with fewer sequences is the plan; one at the lower bound ends the search.
3. The plan is a list of rank ranges for each length. Prefix sums over partitions turn local
   ranks into global ones, and each piece finds its place in the plan alone.

Defined cases: a null or empty text has the separator alone; a null document id is kept; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.llm.common import shared_dir, ship, stored
from taxaloom.llm.encoding import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])
#: The most rounds of multiplicative weights in a try. A try has the tilt in tokens of a price that lags behind by all, the share
#: of what is left of a length that a round may take, and by how many tokens' worth a configuration may miss the best (None: it is full).
ROUNDS, TRIES = 400, ((8.0, 0.9, None), (64.0, 0.2, 2.0))


def cut_pieces(docs: DataFrame, tokenizer_json: str, separator_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents. Of a document longer than ``capacity`` the first piece is the short one."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(model.value), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, tokens, at in enc.encode(batch.column(1)):
                out: list[tuple] = []
                tokens = np.insert(tokens.astype("<u4"), at[1:], separator_id)
                at = (at + np.arange(len(at))).tolist()
                for i, (first, end) in enumerate(zip(at[:-1], at[1:], strict=True), begin):
                    n = end - first
                    for k, stop in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                        a = max(0, stop - capacity)
                        out.append((ids[i], k, a, stop - a, zlib.crc32(tokens[first + a : first + stop]), part, ranks[stop - a]))
                        ranks[stop - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), PIECES, strict=True)], schema=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity`` the highest total price of lengths that fit, repeats allowed, and a length of the
    best choice (0: none, the room less one token has the same). prices[n] is of length n; one that isn't positive is left out."""
    lengths = np.flatnonzero(prices[: capacity + 1] > 0)
    worth = prices[lengths]
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            values = worth[: fits[c]] + best[c - lengths[: fits[c]]]
            k = int(values.argmax())
            if values[k] > best[c]:
                best[c], take[c] = values[k], lengths[k]
    return best, take


def configuration(room: int, best: np.ndarray, take: np.ndarray, prices: np.ndarray, left: np.ndarray | None = None, holds: int = 0) -> Counter[int]:
    """The lengths worth most in ``room`` beside one piece of ``holds``. Given what is left of each length, none is
    taken more often than that; the choice may then be less than the best."""
    found: Counter[int] = Counter({holds: 1} if holds else {})
    c = room - holds
    while c > 0:
        n = int(take[c])
        if n and left is not None and found[n] >= left[n]:
            values = np.where(prices[1 : c + 1] > 0, prices[1 : c + 1] + best[c - 1 :: -1], -1.0)
            values[[x - 1 for x, k in found.items() if x <= c and k >= left[x]]] = -1.0
            n = int(values.argmax()) + 1
            if values[n - 1] < 0:
                break
        if n:
            found[n] += 1
        c -= n or 1
    return found


def solve(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, longest first) with how many sequences use each. demand[n]: pieces of length n.

    Every piece is placed: by the program's configurations first, then by best-fit decreasing over what these left.
    """
    size = np.arange(capacity + 1)
    bound = max(-(-int((demand * size).sum()) // capacity), int(demand[capacity // 2 + 1 :].sum()))
    chosen: Counter[tuple[int, ...]] | None = None
    for one in TRIES:
        plan, left = program(demand, capacity, rounds, *one)
        for content, n in best_fit(left, capacity).items():
            plan[content] += n
        if chosen is None or sum(plan.values()) < sum(chosen.values()):
            chosen = plan
        if sum(chosen.values()) <= 1.0001 * bound + 1:
            break
    return sorted(chosen.items(), key=lambda x: (-sum(x[0]), x[0]))


def program(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, tilt: float = TRIES[0][0], step: float = TRIES[0][1], slack: float | None = TRIES[0][2]) -> tuple[Counter[tuple[int, ...]], np.ndarray]:
    """The configuration program's sequences, and the demand that they leave."""
    left, size = demand.astype(np.int64), np.arange(capacity + 1)
    plan: Counter[tuple[int, ...]] = Counter()
    if left[capacity]:
        plan[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    total, whole = np.maximum(left, 1), int((left * size).sum())
    bounded = False
    for _ in range(rounds):
        if not left.any():
            break
        # The share of a length that is still uncovered, against that of all tokens; of two that lag alike the larger is worth more.
        lag = left / total / max((left * size).sum() / whole, 1e-12)
        price = np.where(left > 0, size / capacity * np.exp(np.minimum(tilt * (lag - 1 + size / capacity) / capacity, 1.0)), 0.0)
        best, take = knapsack(price, capacity)
        allowed, placed = np.ceil(left * step).astype(np.int64), 0
        for n in np.flatnonzero(left)[::-1].tolist():
            if allowed[n] <= 0:
                continue
            found = configuration(capacity, best, take, price, allowed if bounded else None, holds=n)
            if slack is None:
                good = sum(m * k for m, k in found.items()) == capacity
            else:
                good = sum(price[m] * k for m, k in found.items()) >= best[capacity] * (1 - slack / capacity)
            units = min(int(allowed[m]) // k for m, k in found.items())
            if good and units > 0:
                placed += units
                plan[tuple(sorted(found.elements(), reverse=True))] += units
                for m, k in found.items():
                    allowed[m] -= units * k
                    left[m] -= units * k
        # When the best configurations ask for more pieces of a length than there are, choices are bounded by what is left.
        if not placed:
            if bounded:
                break
            bounded = True
    return plan, left


def best_fit(left: np.ndarray, capacity: int) -> Counter[tuple[int, ...]]:
    """Best-fit decreasing over counts: all bins with the same content are handled as one."""
    bins: dict[int, Counter[tuple[int, ...]]] = {}
    done: Counter[tuple[int, ...]] = Counter()
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            free = min((f for f in bins if f >= n), default=None)
            if free is None:
                k = capacity // n
                for size, count in ((k, todo // k), (todo % k, 1)):
                    if size and count:
                        content = (n,) * size
                        if capacity - n * size:
                            bins.setdefault(capacity - n * size, Counter())[content] += count
                        else:
                            done[content] += count
                todo = 0
                continue
            content, count = next(iter(bins[free].items()))
            k = free // n
            whole = min(count, todo // k)
            k, whole = (k, whole) if whole else (todo, 1)
            if count > whole:
                bins[free][content] -= whole
            else:
                del bins[free][content]
                if not bins[free]:
                    del bins[free]
            rest, content = free - n * k, content + (n,) * k
            if rest:
                bins.setdefault(rest, Counter())[content] += whole
            else:
                done[content] += whole
            todo -= whole * k
    for group in bins.values():
        done.update(group)
    out: Counter[tuple[int, ...]] = Counter()
    for content, count in done.items():
        out[tuple(sorted(content, reverse=True))] += count
    return out


def layout(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces of it in a sequence, first sequence, offset of its first piece)."""
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter[int] = Counter()
    sequence = 0
    for content, count in plan:
        offset = 0
        for n, k in sorted(Counter(content).items(), reverse=True):
            ranges.setdefault(n, []).append((rank[n], k, sequence, offset))
            rank[n] += k * count
            offset += n * k
        sequence += count
    return {n: np.array(x, np.int64) for n, x in ranges.items()}


def pack(docs: DataFrame, tokenizer_json: str, separator_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its sequence and its offset there."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_json, separator_id, capacity, id_col, text_col), shared_dir(spark, "packing"), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    ranges = spark.sparkContext.broadcast(layout(solve(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                table = ranges.value[n]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                inside = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + inside // row[:, 1]
                offset[own] = row[:, 3] + inside % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
