"""Web archives: captures written as WARC records, and records put together again as captures (operator 13).

A capture is up to three records: a request, a response (or a revisit of another capture's response) and metadata. Request
and metadata name the main record in ``WARC-Concurrent-To``. Each record is a gzip member of its own, so a file can be
read from any record on. A task's files have names of their own for each attempt; the manifest, which Spark commits, names the
byte ranges that count.

Reading gives a row for each record; :func:`captures` joins requests, main records and metadata through their concurrent-to
identifiers, inside their file, and emits one nested row for each capture.

Defined cases: a null text is an empty payload; a null id is written as none, comes after all others and is read back as null;
rows that share the largest id of a payload are responses all, others with that payload revisit the one of the largest
address; a null address is left out of the records; repeated rows are captures of their own, whose responses may have one identifier in different files; a record without a main
record in its file is an orphan (:func:`orphans`); an empty table gives no files and no captures; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.llm.common import ship

#: Bytes after which a task begins another archive, and after which another range of one begins.
ARCHIVE_BYTES, RANGE_BYTES = 1 << 30, 32 << 20
#: Bytes of records that are handed on at once.
BATCH_BYTES = 4 << 20
MANIFEST = "file string, start long, end long, records long"
RECORD = "file string, record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string, fields map<string,string>, payload_bytes long, payload_digest string, intact boolean, payload binary"
_SCHEMA = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("content_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary()),
])
#: What a revisit of an equal payload states, by the format's version 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as archives state it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    """One record as a gzip member; an underscore in a field's name stands for a hyphen, fields without a value are left out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>"} | {k.replace("_", "-"): v for k, v in fields.items()} | {"Content-Length": str(len(block))}
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n") + packer.flush()


def _plain(address: str | None) -> str | None:
    """An address in one line: blanks and control characters as per cent."""
    if address is None:
        return None
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in address)


def write_captures(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes each row as request, response or revisit, and metadata, and returns the manifest.

    Of equal payloads that of the largest id is the response. Payloads are told apart by SHA-256, grouped before the
    shuffle; the join back may be split wherever one payload has very many rows.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    tops = rows.groupBy(F.col("key").alias("top_key")).agg(F.max(F.struct("id", "url")).alias("top"))
    chosen = rows.join(tops, F.col("key") == F.col("top_key")).select("id", "url", "payload", "key", F.col("top.id").alias("top_id"), F.col("top.url").alias("top_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, name, at, ranges, used = None, "", 0, [], set()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at, used = store.open_output_stream(f"{path}/{name}", compression=None), 0, set()
                    head = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", WARC_Date=date, WARC_Filename=name, Content_Type="application/warc-fields")
                    out.write(head)
                    at += len(head)
                if not ranges or ranges[-1]["file"] != name or at - ranges[-1]["start"] >= range_bytes:
                    ranges.append({"file": name, "start": at, "end": at, "records": 0})
                for part in _capture(*row, date, used):
                    out.write(part)
                    at += len(part)
                    ranges[-1] |= {"end": at, "records": ranges[-1]["records"] + 1}
                if at >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if ranges:
            yield pa.RecordBatch.from_pylist(ranges, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("records", pa.int64())]))

    chosen.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def response_id(key: str, page_id: int | None, url: str | None) -> str:
    """The same in every task: a revisit can name a response that another task writes."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(json.dumps([key, page_id, url]).encode()).digest()[:16], version=5)}"


def _capture(page_id: int | None, url: str | None, payload: bytes, key: str, top_id: int | None, top_url: str | None, date: str, used: set[str]) -> Iterator[bytes]:
    """``used``: the response ids that the file has; a repeated row gets another."""
    target, sha = _plain(url), f"sha1:{digest(payload)}"
    shared = {"WARC_Date": date, "WARC_Target_URI": target and f"<{target}>"}
    first = f"urn:uuid:{uuid.uuid4()}"
    if page_id == top_id:
        first = own if (own := response_id(key, page_id, url)) not in used else first
        used.add(first)
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        yield record("response", first, body, **shared, WARC_Payload_Digest=sha, Content_Type="application/http;msgtype=response")
    else:
        yield record("revisit", first, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", **shared, WARC_Profile=PROFILE, WARC_Refers_To=f"<{response_id(key, top_id, top_url)}>", WARC_Payload_Digest=sha, Content_Type="application/http;msgtype=response")
    host, _, rest = (target or "").partition("://")[2].partition("/")
    yield record("request", f"urn:uuid:{uuid.uuid4()}", f"GET /{rest} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(), **shared, WARC_Concurrent_To=f"<{first}>", Content_Type="application/http;msgtype=request")
    known = {"page-id": page_id, "url": url}
    yield record("metadata", f"urn:uuid:{uuid.uuid4()}", "".join(f"{k}: {json.dumps(v)}\r\n" for k, v in known.items()).encode(), **shared, WARC_Concurrent_To=f"<{first}>", Content_Type="application/warc-fields")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files and byte ranges, each from one record's beginning to another's end."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """What each gzip member of a stream holds."""
    part, whole = zlib.decompressobj(31), []
    for piece in data:
        while piece:
            whole.append(part.decompress(piece))
            piece = b""
            if part.eof:
                yield b"".join(whole)
                piece, part, whole = part.unused_data, zlib.decompressobj(31), []
    if any(whole):
        raise ValueError("the archive ends inside a record")


def parsed(raw: bytes, file: str) -> dict:
    """A record's columns. The payload of an HTTP message is its body, of any other record the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record begins with {version[:20]!r} in {file}")
    pairs = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
    fields = dict(pairs)
    bare = lambda v: v[1:-1] if v and v.startswith("<") and v.endswith(">") else v
    size, kind, content = int(fields.get("content-length", 0)), fields.get("warc-type"), fields.get("content-type")
    block = rest[:size]
    if len(block) < size:
        raise ValueError(f"a record in {file} is shorter than it says")
    payload = block.partition(b"\r\n\r\n")[2] if (content or "").startswith("application/http") else block
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    found = digest(payload)
    more = {}
    if content == "application/warc-fields":
        more = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n") if line)}
    return {
        "file": file, "record_id": bare(fields.get("warc-record-id")), "kind": kind, "concurrent_to": [bare(v) for k, v in pairs if k == "warc-concurrent-to"], "refers_to": bare(fields.get("warc-refers-to")),
        "target_uri": bare(fields.get("warc-target-uri")), "date": fields.get("warc-date"), "content_type": content, "fields": list(more.items()), "payload_bytes": len(payload),
        "payload_digest": stated if kind == "revisit" else found, "intact": kind == "revisit" or stated in (None, found), "payload": payload,
    }


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """A row for each record of the manifest's ranges, each range read by itself. Sizes and digests are those of what was read; a
    revisit has no payload and keeps its stated digest. Without ``payload`` the bytes stay in the task."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{path}/{r['file']}") as f:
                    f.seek(r["start"])
                    pieces = (f.read(min(1 << 20, r["end"] - a)) for a in range(r["start"], r["end"], 1 << 20))
                    held, size = [], 0
                    for raw in members(pieces):
                        held.append(parsed(raw, r["file"]))
                        size += len(raw) if payload else 1000
                        if not payload:
                            held[-1]["payload"] = None
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest(spark, folder).repartition(tasks).mapInArrow(read, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: ``main``, the ``request`` and ``metadata`` that name it or that it names
    (the smallest identifier where there are several, with their numbers), all structs of the records' columns."""
    main = records.where(F.col("kind").isin("response", "revisit"))
    out = main.select(F.col("file").alias("_file"), F.col("record_id").alias("_id"), F.struct(*records.columns).alias("main"))
    back = main.select("file", F.col("record_id").alias("_main"), F.explode("concurrent_to").alias("_other"))
    for kind in ("request", "metadata"):
        own = records.where(F.col("kind") == kind).select("file", "record_id", "concurrent_to", F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "fields")], "fields").alias("_r"))
        named = own.select("file", F.explode("concurrent_to").alias("_main"), "_r")
        naming = back.join(own.withColumnRenamed("file", "_f"), (F.col("file") == F.col("_f")) & (F.col("_other") == F.col("record_id"))).select("file", "_main", "_r")
        # The record of the smallest identifier; maps can't be ordered, so the identifier decides alone.
        one = named.unionByName(naming).groupBy("file", "_main").agg(F.min_by("_r", "_r.record_id").alias(kind), F.countDistinct("_r.record_id").alias(f"n_{kind}"))
        out = out.join(one, (F.col("_file") == F.col("file")) & (F.col("_id") == F.col("_main")), "left").drop("file", "_main")
        out = out.withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0)).cast("long"))
    return out.drop("_file", "_id")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata whose concurrent-to identifiers name no main record of their file, and that no main record names."""
    main = records.where(F.col("kind").isin("response", "revisit"))
    ids = main.select(F.col("file").alias("_file"), F.col("record_id").alias("_id"))
    named = main.select(F.col("file").alias("_file"), F.explode("concurrent_to").alias("_id"))
    rest = records.where(F.col("kind").isin("request", "metadata"))
    at = F.col("file") == F.col("_file")
    linked = rest.select("file", "record_id", F.explode("concurrent_to").alias("_to")).join(ids, at & (F.col("_to") == F.col("_id")), "left_semi").select(F.col("file").alias("_file"), F.col("record_id").alias("_id"))
    return rest.join(linked.unionByName(named), at & (F.col("record_id") == F.col("_id")), "left_anti")


def resolved(found: DataFrame) -> DataFrame:
    """Captures with ``page_id`` and ``url`` of their metadata, and of a revisit the response that it refers to (``target``:
    record_id, page_id, payload_bytes), which may lie in any file. Very many revisits of one response are split."""
    known = found.withColumns({"page_id": metadata("page-id").cast("long"), "url": F.get_json_object(F.concat(F.lit('{"v":'), metadata("url"), F.lit("}")), "$.v")})
    target = known.where(F.col("main.kind") == "response").groupBy(F.col("main.record_id").alias("_id")).agg(F.max("page_id").alias("_page"), F.max("main.payload_bytes").alias("_bytes"))
    out = known.join(target, F.col("main.refers_to") == F.col("_id"), "left")
    return out.withColumn("target", F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("record_id"), F.col("_page").alias("page_id"), F.col("_bytes").alias("payload_bytes")))).drop("_id", "_page", "_bytes")


def metadata(field: str) -> Column:
    return F.nullif(F.col("metadata.fields")[field], F.lit("null"))


def digests(found: DataFrame) -> DataFrame:
    """Of resolved captures: id, size and digest of the full payload, type, and the id that a revisit refers to."""
    return found.select("page_id", F.coalesce("target.payload_bytes", "main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("main.kind").alias("record_type"), F.col("target.page_id").alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.col("main.intact").alias("intact"))


#: The digests in DuckDB's SQL.
SQL = """with p as (select page_id, coalesce(html, '') as h from pages), g as (select *, sha1(h) as s, max(page_id) over (partition by h) as top from p)
  select page_id, octet_length(encode(h))::bigint as payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (i // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))) & 31) + 1)::bigint, 1)), '') as payload_digest,
    case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to, true as has_request, true as intact from g"""
