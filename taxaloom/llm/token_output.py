"""Token ids as flat binary files (operator 1).

Documents are ordered by id over range partitions, whose number follows the bytes of text. Each partition is one shard of
two files: ``.bin``, flat unsigned ids (16 bits where the vocabulary fits, else 32), and ``.idx``, signed 64-bit
numbers: the document ids, then n + 1 token offsets inside the shard. The manifest has a row for
each shard with its token base, the prefix sum of the token counts before it.

Defined cases: a null or empty text has the end id alone; a null document id comes first and is read
back as null; rows that share an id are all kept, in the order of the input, and may lie in several shards; an empty
table gives no documents; other columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.llm.common import ship
from taxaloom.llm.encoding import encoder

#: Stands for a null document id in a file.
NULL_ID = np.iinfo(np.int64).min
#: Bytes of text that a shard holds, about.
SHARD_BYTES = 128 << 20
WRITTEN = "shard int, file string, id_bytes int, docs long, tokens long"
MANIFEST = f"{WRITTEN}, doc_base long, token_base long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def write_tokens(docs: DataFrame, folder: str, tokenizer_json: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes all documents as shards under ``folder`` (URI) and returns the manifest.

    A shard's files get a name of their own for each attempt; the manifest, which Spark commits, names
    those that count. The driver sees a row for each shard.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    if not shards:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    model = spark.sparkContext.broadcast(tokenizer_json)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(model.value), TaskContext.get().partitionId()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, ids, lengths, size = f"{shard:07d}-{uuid.uuid4().hex}", [], [], enc.dtype.itemsize
        out = None
        for batch in batches:
            ids.append(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            out = out or store.open_output_stream(f"{path}/{name}.bin")
            for _, tokens, at in enc.encode(batch.column(1)):
                out.write(np.insert(tokens, at[1:], end_id).tobytes())
                lengths.append(np.diff(at) + 1)
        if out is None:
            return
        out.close()
        ids = np.concatenate(ids).astype("<i8")
        offsets = np.cumsum(np.concatenate([[0], *lengths]), dtype="<i8")
        with store.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(ids.tobytes())
            index.write(offsets.tobytes())
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "id_bytes": size, "docs": len(ids), "tokens": int(offsets[-1])}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("id_bytes", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    ordered = rows.repartitionByRange(shards, "id", "place").sortWithinPartitions("id", "place").drop("place")
    ordered.mapInArrow(write, WRITTEN).write.parquet(f"{folder}/written")
    found, doc_base, token_base = [], 0, 0
    for r in spark.read.schema(WRITTEN).parquet(f"{folder}/written").orderBy("shard").collect():
        found.append((*r, doc_base, token_base))
        doc_base, token_base = doc_base + r.docs, token_base + r.tokens
    manifest = spark.createDataFrame(found, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return manifest


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the shards back, each memory-mapped in its task: a row for each document, with its place
    among all tokens, its number of tokens and the checksum of its ids as 32-bit little-endian integers."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped(folder, row) as (ids, docs, offsets):
                    for a in range(0, len(docs), 4096):
                        b = min(a + 4096, len(docs))
                        at = offsets[a : b + 1]
                        crc = [zlib.crc32(ids[p:q].astype("<u4").tobytes()) for p, q in zip(at[:-1], at[1:], strict=True)]
                        own = docs[a:b]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(at[:-1] + row["token_base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(np.full(b - a, row["shard"], np.int32))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(tasks).mapInArrow(read, READ)


class mapped:
    """A shard's ids, document ids and offsets as memory maps. A remote file is first copied into the
    task's own temporary folder, which goes with the task."""

    def __init__(self, folder: str, row: dict) -> None:
        self.folder, self.row, self.copy = folder, row, None

    def __enter__(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        store, path = fs.FileSystem.from_uri(self.folder)
        base = f"{path}/{self.row['file']}"
        if not isinstance(store, fs.LocalFileSystem):
            self.copy = tempfile.mkdtemp()
            local = os.path.join(self.copy, "shard")
            for end in (".bin", ".idx"):
                fs.copy_files(base + end, local + end, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            base = local
        ids = np.memmap(f"{base}.bin", f"<u{self.row['id_bytes']}", "r")
        index = np.memmap(f"{base}.idx", "<i8", "r")
        n = self.row["docs"]
        return ids, index[:n], index[n:]

    def __exit__(self, *_: object) -> None:
        if self.copy:
            shutil.rmtree(self.copy, ignore_errors=True)
