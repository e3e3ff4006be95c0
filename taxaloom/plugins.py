"""The user's own sources, filters, regions and aggregates."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.package import ship

from taxaloom.schemas import CHECKLIST, assert_columns

Source = Callable[[SparkSession], DataFrame]
TableFunction = Callable[[DataFrame], DataFrame]


def gather(spark: SparkSession, sources: Mapping[str, Source]) -> DataFrame:
    """One checklist of all sources, each checked against the schema."""
    return reduce(DataFrame.unionByName, [assert_columns(make(spark), CHECKLIST) for make in sources.values()])


def apply_filters(df: DataFrame, *filters: TableFunction) -> DataFrame:
    return reduce(lambda t, f: t.transform(f), filters, df)


def prepare_region(regions: DataFrame, handle: TableFunction) -> DataFrame:
    """The user's table function over the regions; rows with nulls go."""
    return regions.transform(handle).dropna()


def partial_aggregate(df: DataFrame, keys: list[str], execute: TableFunction, process: TableFunction, salt: int = 16) -> DataFrame:
    """A two-step aggregate: ``execute`` on rows spread over (keys, salt), ``process`` on what it returns by keys.

    ``execute`` sees the column ``_salt`` and must group by it too; ``process`` combines the partial rows.
    """
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt)))
    return process(execute(spread).drop("_salt"))


class Aggregate(ABC):
    """A user's own aggregate with a state of bytes. States should stay small however many rows they hold; :meth:`merge` may be given states in
    any order."""

    @abstractmethod
    def init(self) -> bytes:
        """The state of no rows."""

    @abstractmethod
    def execute(self, state: bytes, rows: pa.RecordBatch) -> bytes:
        """The state with some rows more."""

    @abstractmethod
    def merge(self, a: bytes, b: bytes) -> bytes:
        """The state of both states' rows."""

    @abstractmethod
    def process(self, state: bytes) -> dict:
        """The result's columns."""


#: Keys whose states a task holds at once, and states that are merged by one call.
HELD_KEYS, FAN_IN = 10_000, 64


def own_aggregate(df: DataFrame, keys: list[str], aggregate: Aggregate, result: str, held_keys: int = HELD_KEYS, fan_in: int = FAN_IN) -> DataFrame:
    """The aggregate by keys: keys and the columns of ``result`` (DDL).

    Tasks make a state for each key they meet, and hand states on when they hold many. States of a key are merged in a tree, those of ``fan_in`` parts
    together, so that no task gets all states of a key that is in every part. Rows with null keys are a group.
    """
    ship(df.sparkSession)
    values = [c for c in df.columns if c not in keys]
    kinds = dict(df.dtypes)
    states = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["_salt long", "_state binary"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, bytes] = {}
        part = TaskContext.get().partitionId()

        def handed_on() -> pa.RecordBatch:
            salt = part
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([salt] * len(held), pa.int64()), pa.array(list(held.values()), pa.binary())], names=[*keys, "_salt", "_state"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for key, rows in _by_key(batch, keys):
                held[key] = aggregate.execute(held.get(key) or aggregate.init(), rows.select(values))
            if len(held) >= held_keys:
                yield handed_on()
                held = {}
        if held:
            yield handed_on()

    def merged(table: pa.Table) -> pa.Table:
        state = reduce(aggregate.merge, table.column("_state").to_pylist())
        return pa.table([*[table.column(k).slice(0, 1) for k in keys], table.column("_salt").slice(0, 1), pa.array([state], pa.binary())], names=[*keys, "_salt", "_state"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [aggregate.process(s) for s in batch.column("_state").to_pylist()]
            if rows:
                names = list(rows[0])
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array([r[n] for r in rows]) for n in names]], names=[*keys, *names])

    out = df.select(*[F.col(f"`{c}`") for c in [*keys, *values]]).mapInArrow(partial, states)
    # Parts of the input bound the states of a key: a level for each factor of fan_in, the last without a salt.
    levels, parts = 0, df.rdd.getNumPartitions()
    while parts > fan_in:
        levels, parts = levels + 1, -(-parts // fan_in)
    for _ in range(levels):
        out = out.withColumn("_salt", F.floor(F.col("_salt") / fan_in)).groupBy(*keys, "_salt").applyInArrow(merged, states)
    out = out.groupBy(*keys).applyInArrow(merged, states)
    return out.mapInArrow(finished, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], result]))


def _by_key(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each key."""
    table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
    groups = table.group_by(keys).aggregate([("_row", "list")])
    for *key, places in zip(*[groups.column(k).to_pylist() for k in keys], groups.column("_row_list").to_pylist(), strict=True):
        yield tuple(key), batch.take(pa.array(places, pa.int64()))


class HeavyValues(Aggregate):
    """The most frequent values of a column, by Misra and Gries: of n rows, a value's ``count`` is at most its true number and at most n / ``size`` less, so every
    value of more rows than that is there. Returns rows (n), values and counts."""

    def __init__(self, column: str, size: int = 100) -> None:
        self.column, self.size = column, size

    def init(self) -> bytes:
        return _packed(0, {})

    def execute(self, state: bytes, rows: pa.RecordBatch) -> bytes:
        n, held = _unpacked(state)
        own = rows.column(self.column).drop_null()
        for x in own.value_counts().to_pylist():
            held[x["values"]] = held.get(x["values"], 0) + x["counts"]
        return _packed(n + len(own), self._cut(held))

    def merge(self, a: bytes, b: bytes) -> bytes:
        (n, x), (m, y) = _unpacked(a), _unpacked(b)
        return _packed(n + m, self._cut({k: x.get(k, 0) + y.get(k, 0) for k in x.keys() | y.keys()}))

    def process(self, state: bytes) -> dict:
        n, held = _unpacked(state)
        order = sorted(held.items(), key=lambda x: (-x[1], str(x[0])))
        return {"n": n, "values": [str(k) for k, _ in order], "counts": [c for _, c in order]}

    def _cut(self, held: dict) -> dict:
        """At most ``size`` values: all lose the count of the first that is too many."""
        if len(held) <= self.size:
            return held
        less = sorted(held.values(), reverse=True)[self.size]
        return {k: c - less for k, c in held.items() if c > less}


def _packed(n: int, held: dict) -> bytes:
    return json.dumps([n, list(held.items())]).encode()


def _unpacked(state: bytes) -> tuple[int, dict]:
    n, held = json.loads(state)
    return n, {k: c for k, c in held}
