"""A streaming source over delimited files that grow: offsets are bytes inside each file.

Each batch takes all whole lines that have arrived in any file of a folder since the last one; a line without its end waits. What a
batch reads is fixed by the offsets in the stream's checkpoint, so a batch that runs again reads the same bytes. Files only grow: one that
was cut or replaced by a shorter one raises. Long stretches are read in ranges, each by a task of its own.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from taxaloom.package import ship

#: Bytes of a file that one task reads, and bytes that are parsed at once.
RANGE_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class Stretch(InputPartition):
    """Lines that begin in bytes [start, stop) of a file, of which ``end`` bytes have arrived in whole lines."""

    def __init__(self, file: str, start: int, stop: int, end: int) -> None:
        super().__init__(None)
        self.file, self.start, self.stop, self.end = file, start, stop, end


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").schema(...).option("sep", "\\t").option("header", "true").load(folder)``.

    Fields are split at every separator, without quotes; an empty field is null unless its column is a string. Folders inside the folder and names
    that begin with a dot or an underscore are left alone.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def streamReader(self, schema: StructType) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options), schema)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.folder, self.sep, self.header = low["path"], low.get("sep", "\t"), low.get("header", "false").lower() == "true"
        self.range_bytes = int(low.get("rangebytes", RANGE_BYTES))
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if unknown := [t for _, t in self.columns if t not in _TYPES]:
            raise ValueError(f"no columns of {unknown[0]}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, path = fs.FileSystem.from_uri(self.folder)
        found = [i for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        ends = {i.base_name: whole_lines(store, i.path, i.size) for i in sorted(found, key=lambda i: i.base_name)}
        return {name: end for name, end in ends.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, to in end.items():
            since = start.get(name, 0)
            if to < since:
                raise ValueError(f"{name} had {since} bytes and has {to}")
            out += [Stretch(name, a, min(a + self.range_bytes, to), to) for a in range(since, to, self.range_bytes)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(f"{path}/{partition.file}") as f:
            for text in lines_of(f, partition.start, partition.stop, partition.end, skip_first=self.header):
                yield from self.parsed(text)

    def parsed(self, text: bytes) -> Iterator[pa.RecordBatch]:
        names = [c for c, _ in self.columns]
        table = csv.read_csv(
            io.BytesIO(text), csv.ReadOptions(column_names=names, use_threads=False), csv.ParseOptions(delimiter=self.sep, quote_char=False, newlines_in_values=False, ignore_empty_lines=len(names) > 1),
            csv.ConvertOptions(column_types={c: _TYPES[t] for c, t in self.columns}, strings_can_be_null=False, null_values=[""]),
        )
        yield from table.combine_chunks().to_batches()


def whole_lines(store: fs.FileSystem, path: str, size: int, step: int = 1 << 16) -> int:
    """Bytes up to the last line end."""
    with store.open_input_file(path) as f:
        to = size
        while to > 0:
            at = max(0, to - step)
            f.seek(at)
            found = f.read(to - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            to = at
    return 0


def lines_of(f: io.IOBase, start: int, stop: int, end: int, skip_first: bool = False, block: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Whole lines that begin in [start, stop), in blocks; ``end`` is the end of a line."""
    at = start
    if start > 0:
        # The line that holds the byte before is another stretch's.
        at = _next_line(f, start - 1, end)
    elif skip_first:
        at = _next_line(f, 0, end)
    while at < stop:
        to = min(at + block, stop)
        # To the end of the line that holds byte to - 1.
        to = _next_line(f, to - 1, end)
        f.seek(at)
        yield f.read(to - at)
        at = to


def _next_line(f: io.IOBase, at: int, end: int, step: int = 1 << 14) -> int:
    """The byte after the first line end at or behind ``at``."""
    while at < end:
        f.seek(at)
        piece = f.read(min(step, end - at))
        if (found := piece.find(b"\n")) >= 0:
            return at + found + 1
        at += len(piece)
    return end


def ingest_growing(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, sep: str = "\t", header: bool = False, transform: Callable[[DataFrame], DataFrame] | None = None, range_bytes: int = RANGE_BYTES) -> int:
    """Appends all whole lines that are new in the folder to ``target`` (Parquet) and returns the number of batches.

    ``transform`` is applied to each batch, as the chain of matching and filtering that follows. A batch is written to a folder of its number, so
    one that runs again after a failure replaces itself: no line is lost, none is there twice.
    """
    ship(spark)
    spark.dataSource.register(GrowingFiles)
    stream = spark.readStream.format("growing_files").schema(schema).option("sep", sep).option("header", str(header).lower()).option("rangeBytes", range_bytes).load(source)
    done: set[int] = set()

    def append(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.add(number)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
