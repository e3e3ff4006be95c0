"""Media columns over archive folders (operator 3).

``write_media`` stores each text as a mono 8-bit WAV member of ZIP archives, one archive or more for each
partition. ``MediaArchives`` is a Spark data source over such a folder: it plans byte ranges of the
archives; a task reads the archive's directory, takes the members whose headers start in its range,
streams them as Arrow batches of bounded size and tries each member again, by its offset, when a read fails.

Defined cases: a null or empty text is 64 zero bytes; a null document id is read back as null; repeated rows
are kept; an empty table gives an empty result; other columns are ignored. A member that can't be
read after all tries gives a row with its error and no media.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from taxaloom.llm.common import ship

#: Payloads are padded with zeros to a multiple of this.
UNIT = 64
SAMPLE_RATE = 8000
MEMBERS = "archive string, member string, offset long, media binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("media", pa.large_binary()), ("error", pa.string())])
#: Bytes in a batch (one larger member makes a larger batch), and tries of a member.
BATCH_BYTES, TRIES = 4 << 20, 3


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with padding, and their number without."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; its last chunk holds nothing but them."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(samples), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    view, at = memoryview(media), 12
    while at + 8 <= len(view):
        kind, n = struct.unpack_from("<4sI", view, at)
        if kind == b"data":
            return bytes(view[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    raise ValueError("no samples")


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes the archives under ``folder`` (URI) and returns a row for each.

    An archive is renamed to its partition's name when complete, so a task that runs again replaces its own.
    """
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        part, k, seq, archive, out = context.partitionId(), 0, 0, None, None
        working = f"{path}/.{part}-{context.taskAttemptId()}"

        def close() -> pa.RecordBatch:
            archive.close()
            out.close()
            name = f"part-{part:07d}-{k:04d}.zip"
            store.move(working, f"{path}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "members": [len(archive.filelist)]})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    out = store.open_output_stream(working)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                body, n = payload(text.as_py())
                # The name keeps what the samples can't: order, id and the length without padding.
                archive.writestr(zipfile.ZipInfo(f"{seq:09d}_{'null' if doc is None else doc}_{n}.wav"), wav(body), zipfile.ZIP_DEFLATED, 1)
                seq += 1
                if out.tell() >= archive_bytes:
                    yield close()
                    archive, k = None, k + 1
        if archive is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    done = rows.mapInArrow(write, "archive string, members long")
    done.write.parquet(f"{folder}/_written")
    return docs.sparkSession.read.schema("archive string, members long").parquet(f"{folder}/_written")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, stop: int) -> None:
        super().__init__(None)
        self.archive, self.start, self.stop = archive, start, stop


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").option("rangeBytes", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", 16 << 20))))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int) -> None:
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self.folder)
        files = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        ranges = [Range(f.base_name, a, min(a + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) if f.base_name.endswith(".zip") for a in range(0, f.size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        store, path = fs.FileSystem.from_uri(self.folder)
        where = f"{path}/{partition.archive}"
        with store.open_input_file(where) as f, zipfile.ZipFile(f) as z:
            own = [i for i in z.infolist() if partition.start <= i.header_offset < partition.stop]
        rows, size, source = [], 0, None
        try:
            for info in own:
                media = error = None
                for attempt in range(TRIES):
                    try:
                        source = source or zipfile.ZipFile(store.open_input_file(where))
                        media, error = source.read(info), None
                        break
                    except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                        error = f"{type(e).__name__}: {e}"
                        with contextlib.suppress(Exception):
                            source.close()
                        source = None
                        time.sleep(0.05 * attempt)
                rows.append((partition.archive, info.filename, info.header_offset, media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            if source:
                source.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([pa.field(f.name, pa.binary() if f.name == "media" else f.type) for f in _ARROW])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_media(spark: SparkSession, folder: str, range_bytes: int = 16 << 20) -> DataFrame:
    """Members of all archives of a folder: archive, member, offset, media, error."""
    ship(spark)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("rangeBytes", range_bytes).load(folder)


def describe(samples: bytes) -> str:
    """Mean, deviation, crossings of the mean and entropy (bits) of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    mean = float(counts @ np.arange(256)) / len(x)
    deviation = float(counts @ (np.arange(256) - mean) ** 2 / len(x)) ** 0.5
    above = x > mean
    return f"mean={mean:.4f};sd={deviation:.4f};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};entropy={float(-(p * np.log2(p)).sum()):.4f};peak={int(x.max())}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_features(media: DataFrame) -> DataFrame:
    """What the stored bytes of each member say; a row with an error keeps its id and has nulls."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, data, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                _, doc, n = member.removesuffix(".wav").split("_")
                doc_id = None if doc == "null" else int(doc)
                if error is not None:
                    rows.append((doc_id, int(n), None, None, None, None, None, None, error))
                    continue
                media = data.as_py()
                body = samples_of(media)
                rows.append((doc_id, int(n), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(body), None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return media.select("member", "media", "error").mapInArrow(features, FEATURES)


__all__ = ["MediaArchives", "describe", "media_features", "payload", "read_media", "samples_of", "wav", "write_media"]
