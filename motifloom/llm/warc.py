"""WARC 1.1 archives: writing captures, reading records, assembling transactions.

A capture is three records: ``response`` (or ``revisit`` of an equal payload), ``request`` and
``metadata``; the last two name the first in WARC-Concurrent-To.  Every record is a gzip member
of its own.  Files are written by the tasks into the shared folder, whole or not at all, and
only those in the manifest count, so lost or repeated tasks leave no trace in the result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm._shared import filesystem, put_file, shared_dir, shuffle_partitions, stored
from motifloom.llm._text import binary

FILE_BYTES = 32 << 20
HOT_ROWS = 1000
SALTS = 64
_SPACE = uuid.UUID("6d1f2f0e-2f7b-5c3a-9a34-8a1b5a3f7c10")
_MANIFEST = "path string, records long"
RECORD = "file string, record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, body binary"


def _member(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + body + b"\r\n\r\n") + pack.flush()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {n}')}>"


def _uri(url: str | None, page_id) -> str:
    """The URL as far as a header line can hold it; the metadata record has it unchanged."""
    text = "".join(c if 32 < ord(c) < 127 else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "")
    return text or f"urn:page:{page_id}"


def capture_records(page_id, url: str | None, payload: bytes, refers: int | None, revisit: bool, n: int, date: str) -> bytes:
    """The three gzip members of one capture."""
    digest = payload_digest(payload)
    own = _record_id(f"revisit {page_id}" if revisit else page_id, digest, n)
    common = [("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id))]
    if revisit:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers, digest, 0))]
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        kind = [("WARC-Type", "response")]
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    first = _member([*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], body)
    path = "/" + "/".join(_uri(url, page_id).split("/")[3:])
    request = _member(
        [("WARC-Type", "request"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, own + ' request')}>"), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        f"GET {path} HTTP/1.1\r\n\r\n".encode(),
    )
    about = json.dumps({"page_id": page_id, "url": url, "payload_bytes": len(payload)}).encode()
    metadata = _member(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, own + ' metadata')}>"), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/json")],
        about,
    )
    return first + request + metadata


def write_warc(pages: DataFrame, min_payload_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one capture per row of ``pages``; returns the manifest (path, records), already stored.

    Of rows with equal payloads of at least ``min_payload_bytes`` the one with the largest id is
    a response and the others are revisits of it; smaller payloads are all responses.  A null
    payload is an empty one; a null id is smaller than any other; rows equal in id and payload
    are responses each.  Empty input writes no file.
    """
    spark = pages.sparkSession
    base = shared_dir(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    last = stored(rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")), "payloads")  # one row a task and payload is shuffled
    # a payload with more than a thousandth of all rows, so one of under a thousand, is dealt to many tasks
    total = last.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > max(HOT_ROWS, total // 1000)
    hot = F.broadcast(last.filter(often).select("sha", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = last.select("sha", "last", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    met = rows.join(hot, "sha", "left").withColumn("salt", salt).join(dealt, ["sha", "salt"]).select("page_id", "url", "payload", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = n = 0
        repeats: dict[tuple, int] = {}

        def close() -> pa.RecordBatch:
            path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
            put_file(path, b"".join(parts))
            return pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([3 * n], pa.int64())})

        for b in batches:
            for page_id, url, payload, last_id in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), binary(b.column("payload")), b.column("last").to_pylist(), strict=True):
                revisit = len(payload) >= min_payload_bytes and page_id != last_id
                key = (page_id, hashlib.sha1(payload).digest())
                # rows equal in id and payload are numbered
                seen = repeats.get(key, 0)
                repeats[key] = seen + 1
                parts.append(capture_records(page_id, url, payload, last_id, revisit, seen, date))
                size += len(parts[-1])
                n += 1
                if size >= FILE_BYTES:
                    yield close()
                    parts, size, n = [], 0, 0
        if parts:
            yield close()

    return stored(met.mapInArrow(write, _MANIFEST), "manifest")


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, body) of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        body = stream.read(int(fields["content-length"]))
        if len(body) != int(fields["content-length"]):
            raise ValueError("a record ends early")
        yield fields, body


def _open(path: str) -> io.BufferedIOBase:
    system, local = filesystem(path)
    source = system.open_input_stream(local, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=source)) if path.endswith(".gz") else source


def read_warc(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records (columns of RECORD) of the files in ``manifest(path)``.

    ``body`` is the HTTP payload of responses (null unless ``with_payload``) and the whole block of
    other records.  Payload digests are checked; a file that breaks off or does not match
    fails the read.
    """
    kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with _open(path) as stream:
                    for f, body in parse_records(stream):
                        kind, length = f.get("warc-type"), None
                        digest = (f.get("warc-payload-digest") or "").rpartition(":")[2] or None
                        if kind == "response":
                            body = body.partition(b"\r\n\r\n")[2]
                            length = len(body)
                            if digest is not None and payload_digest(body) != digest:
                                raise ValueError(f"{path}: payload and digest differ in {f.get('warc-record-id')}")
                        keep = with_payload or kind != "response"
                        rows.append((path, f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-date"), digest, length, body if keep else None))
                        size += len(body) if keep else 200
                        if size >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return manifest.select("path").repartition(shuffle_partitions(spark), "path").mapInArrow(read, RECORD)


def assemble(records: DataFrame, apart: str | None = None) -> DataFrame:
    """One nested row per capture: (capture_id, response, request, metadata, requests, metadatas, others).

    ``response`` holds the response or revisit record; ``requests``, ``metadatas`` and ``others``
    the records that name it as concurrent, wherever they lie, or that name one of
    its requests; ``request`` and ``metadata`` are the first of their lists.  Fields are null
    and lists empty if there is none.  A record that names nothing is a capture of its own, so a
    lone request or an unknown type still gives a row.  Lists are ordered by record id.  Archives
    may repeat each other's record ids: ``apart`` is a column that tells them apart (such as
    ``file`` where captures never cross files); it is kept, and records meet only within one value.
    """
    names = records.columns
    whole, given = F.struct(*names), [apart] if apart else []
    key = [*given, "capture_id"]

    def listed(*types: str, other: bool = False) -> Column:
        held = F.col("type").isin(*types)
        return F.array_sort(F.collect_list(F.when(~F.coalesce(held, F.lit(False)) if other else held, whole)), _by_id)

    single = ("response", "revisit", "request", "metadata")
    first = records.groupBy(*given, F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        listed("response", "revisit").alias("responses"), listed("request").alias("requests"), listed("metadata").alias("metadatas"), listed(*single, other=True).alias("others")
    )
    first = stored(first, "captures")
    # groups around a request that itself names a response go to that one
    lone = first.filter(F.size("responses") == 0)
    asked = first.filter(F.size("responses") > 0).select(*given, F.col("capture_id").alias("of"), F.explode("requests.record_id").alias("capture_id"))
    moved = lone.join(asked, key)
    if not moved.isEmpty():
        moved = stored(moved, "moved")
        stay = first.join(moved.select(*key), key, "left_anti")
        together = stay.unionByName(moved.withColumn("capture_id", F.col("of")).drop("of"))
        lists = ("responses", "requests", "metadatas", "others")
        first = together.groupBy(*key).agg(*(F.array_sort(F.flatten(F.collect_list(c)), _by_id).alias(c) for c in lists))
    one = lambda c: F.get(c, F.lit(0))
    return first.select(*key, one("responses").alias("response"), one("requests").alias("request"), one("metadatas").alias("metadata"), "requests", "metadatas", "others")


def _by_id(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a["record_id"], F.lit("")), F.coalesce(b["record_id"], F.lit(""))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
