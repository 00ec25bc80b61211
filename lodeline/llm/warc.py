"""WARC archives: a deterministic sharded writer, and a reader.

Writer. Records are range-sorted by id and then by a hash of the record, which parts records without an id or with the same: a sample of
these keys chosen by a hash (so the same records give the same sample) cuts them into ranges of about equal payload, each range is a shard. A task streams its shard into files that are rolled by their compressed size,
one gzip member for each record; headers, record ids and digests are made anew from the payload. A file is written under a temporary name of
its attempt, in a folder of its own, and moved to its final name when it is complete. An attempt that finds the final name taken leaves that file as it is,
for a task that runs again writes the same bytes to the same names; so a file once named never goes. The manifest, a Spark table of file names
with sizes and digests, lists the files that count; the temporary folder goes when it is written.

Reader. Files are dealt out by a hash of their names to as many tasks as there are files, or as their bytes ask for.

Equal payloads of at least `revisit_bytes` bytes are stored once: the record with the largest id is the response, the others revisit it.

Scale: payloads are shuffled once. Which records revisit which is found from digests alone and travels to the writer as small rows that are
sorted in front of their records; a payload that a third of all records share meets only in an aggregate and in a join whose hot keys
adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, shared_dir

SHARD_BYTES, ROLL_BYTES, REVISIT_BYTES = 32 << 20, 16 << 20, 1000
READ_TASKS, READ_BYTES = 64, 128 << 20  # a task for each file up to so many, beyond that for so many bytes
_TEMPORARY = "_temporary"
_SAMPLE, _MOST_SAMPLE = 16, 1 << 20  # keys for each shard, and in all: beyond 65536 shards' worth of them shards grow with the input
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, number int, name string, bytes long, records long, sha1 string"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}/{digest}'.encode()).digest()[:16], version=4)}>"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None, is_revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP header of the payload but not the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}"]
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    head += [f"X-Page: {page}"] if page is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Roll:
    """Files of one shard."""

    def __init__(self, uri: str, shard: int, roll_bytes: int):
        self.fs, self.dir = fs.FileSystem.from_uri(uri)
        self.shard, self.roll_bytes, self.number, self.out, self.done = shard, roll_bytes, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.dir}/{_TEMPORARY}/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha1 = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            info = f"software: lodeline\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            self._put(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, self.name)}\r\nWARC-Date: {_DATE}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
        self._put(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        data = _member(data)
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        final = f"{self.dir}/{self.name}"
        there = self.fs.get_file_info(final)
        if there.type == fs.FileType.NotFound:
            self.fs.move(self.temporary, final)
        elif there.size == self.size:  # of another attempt, with the same bytes
            self.fs.delete_file(self.temporary)
        else:
            raise ValueError(f"{final} is there with {there.size} bytes in place of {self.size}")
        self.done.append((self.shard, self.number, self.name, self.size, self.records, self.sha1.hexdigest()))
        self.number, self.out = self.number + 1, None


def _shard_bounds(records: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """First key (k, h) of each shard but the first."""
    n, total = records.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, min(-(-(total + 500 * n) // shard_bytes), _MOST_SAMPLE // _SAMPLE))
    if shards == 1:
        return []
    every = max(1, n // max(20_000, _SAMPLE * shards))
    chosen = records.where(F.pmod(F.xxhash64("k", "h"), F.lit(every)) == 0).groupBy("k", "h").agg(F.sum(F.col("bytes") + 500).alias("bytes"))
    sample = sorted(map(tuple, chosen.collect()))
    whole, so_far, bounds = sum(b for _, _, b in sample), 0, []
    for k, h, size in sample:
        if so_far >= whole * (len(bounds) + 1) / shards:
            bounds.append((k, h))
        so_far += size
    return bounds


def _shard(bounds: list[tuple[int, int]]) -> Column:
    """Number of the bounds up to the key (k, h): among every `step`-th of them first, then among those that follow it."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    listed = lambda own: F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in own])), "array<struct<k:bigint,h:bigint>>")
    runs = F.from_json(F.lit(json.dumps([[{"k": k, "h": h} for k, h in bounds[i : i + step]] for i in range(0, len(bounds), step)])), "array<array<struct<k:bigint,h:bigint>>>")
    up_to = lambda own: F.size(F.filter(own, lambda b: b <= F.struct("k", "h")))
    run = up_to(listed(bounds[::step])) - 1
    return F.when(run < 0, 0).otherwise(run * step + up_to(F.get(runs, run)))


def _qualified(spark: SparkSession, uri: str) -> str:
    """uri with a scheme: that of Spark's default file system where it has none, so that the archives lie where Spark's tables do."""
    if "://" in uri or uri.startswith("file:"):
        return uri
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return ("file://" if default.startswith("file:") else default.rstrip("/")) + uri


def write_archives(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of pages under uri; returns the manifest, also kept as JSON in uri/manifest.

    A null payload is empty. A null id sorts first and is left out of the headers; a null url too. Rows with equal ids and payloads are
    all written, none revisits another of the same id. An empty table gives an empty manifest. Other columns are not read.
    """
    uri = _qualified(pages.sparkSession, uri)
    payload, url = F.coalesce(F.col(payload_col), F.lit("")), F.col(url_col).cast("string")
    records = pages.select(id_key(id_col).alias("k"), F.xxhash64(url, payload).alias("h"), url.alias("url"), payload.alias("payload"))
    sizes = records.select("k", "h", F.octet_length("payload").cast("long").alias("bytes"))
    bounds = _shard_bounds(sizes, shard_bytes)
    digests = records.select("k", "h", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")).where(F.col("bytes") >= revisit_bytes)
    responses = digests.groupBy("digest", "bytes").agg(F.max("k").alias("response"), F.min("k").alias("least")).where("least < response")
    joined = digests.withColumn("d", F.xxhash64("digest", "bytes")).join(responses.select(F.xxhash64("digest", "bytes").alias("d"), "digest", "response"), ["d", "digest"])
    notes = joined.where("k < response").select("k", "h", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", "response").distinct()
    rows = notes.unionByName(records.select("k", "h", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("response")))
    dealt = rows.withColumn("shard", _shard(bounds).cast("int")).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "k", "h", "kind", "url", "payload")
    target, folder = fs.FileSystem.from_uri(uri)
    target.create_dir(f"{folder}/{_TEMPORARY}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, notes = None, None, {}
        done: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("shard", "k", "h", "kind", "url", "payload", "digest", "response")), strict=True):
                number, k, h, kind, url, payload, digest, response = (x.as_py() for x in row)
                if roll is None or roll.shard != number:
                    if roll:
                        roll.close()
                        done += roll.done
                    roll = _Roll(uri, number, roll_bytes)
                if (k, h) != at:
                    at, notes = (k, h), {}
                if kind == 0:
                    notes[digest] = response
                    continue
                data, page = payload.encode(), None if k == NULL_ID else k
                found = notes.get(hashlib.sha1(data).hexdigest()) if notes else None
                roll.add(record(page, url, data, found, found is not None))
        if roll:
            roll.close()
            done += roll.done
        columns = list(zip(*done, strict=True)) or [()] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "number", "name", "bytes", "records", "sha1"])

    dealt.mapInArrow(write, _MANIFEST).write.json(f"{uri}/manifest")
    target.delete_dir(f"{folder}/{_TEMPORARY}")
    return pages.sparkSession.read.schema(_MANIFEST).json(f"{uri}/manifest")


def members(source) -> Iterator[bytes]:
    """The gzip members of a stream, each uncompressed."""
    d, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or source.read(1 << 20)
        rest = b""
        if not data:
            return
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            rest, d, parts = d.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; a member holds one as a rule."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode().split("\r\n")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        at = body + int(fields["content-length"]) + 4
        yield fields, data[body : at - 4]


def read_archives(manifest: DataFrame, uri: str, id_col: str = "page_id", with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files: id, payload_bytes, payload_digest (SHA-1, hex), record_type, refers_to, url, payload (null in a revisit, and
    left out without with_payload).

    Digests of stored blocks and payloads are checked as they are read; a mismatch raises ValueError.
    """
    uri = _qualified(manifest.sparkSession, uri)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        n = 7 if with_payload else 6
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:n], types[:n], strict=True)], names=names[:n])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                store, path = fs.FileSystem.from_uri(f"{uri}/{name}")
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for head, block in (r for data in members(source) for r in parse(data)):
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        hex_digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if head["warc-block-digest"] != f"sha1:{_b32(hashlib.sha1(block).hexdigest())}":
                            raise ValueError(f"{name}: the block of {head['warc-record-id']} doesn't match its digest")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != hex_digest:
                            raise ValueError(f"{name}: the payload of {head['warc-record-id']} doesn't match its digest")
                        rows.append((number(head.get("x-page")), length, hex_digest, head["warc-type"], number(head.get("x-refers-to-page")), head.get("warc-target-uri"), payload if with_payload and not revisit else None))
                        held += len(block)
                        if held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    fields = f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(files, max(READ_TASKS, -(-total // READ_BYTES))))
    return manifest.select("name").repartitionById(tasks, F.pmod(F.xxhash64("name"), F.lit(tasks)).cast("int")).mapInArrow(read, fields)


def round_trip(pages: DataFrame, uri: str | None = None, with_payload: bool = True, **options) -> DataFrame:
    """Write pages to archives (by default in a new folder of the shared one) and read them back."""
    uri = uri or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, uri, **options), uri, options.get("id_col", "page_id"), with_payload)
