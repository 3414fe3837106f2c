"""WARC archives: a writer, a normaliser for monolithic gzip files, and a reader.

A crawl often comes as one gzip stream a file, in which nothing can be read
without inflating all that stands before it. The normaliser inflates such a
stream once and writes each record as a gzip member of its own, with a sidecar
index (a JSON line a record: offset, length, type, record id, target URI, date,
payload digest and payload length), so that any record is one seek and one short
inflate away. Records of any type go through as they are, head and block byte for
byte. The payload of an HTTP response is its body, without the framing of chunks;
of a resource or conversion, its block; warcinfo, request and metadata records
have none here. Digests are computed, whatever the record says of its own.

While it does so it can turn records into revisits. Which ones is found from the
index of the raw files alone: digests, lengths and ids are shuffled, payloads
never are. Of the records with one payload, the one with the smallest id stays.

An archive holds at most ARCHIVE_BYTES of payload and one record more, and at most
ARCHIVE_RECORDS; a worker holds one record at a time. Files are written under new
names by each attempt of a task and count only if the attempt's own rows say so,
so that lost or repeated tasks do no harm. Python reads and writes the shared
folder through pyarrow's file systems; the tables are read by Spark.

Edge cases. Null payload: an empty one. Null url: no target URI. Null id: such a
record can revisit another but nothing revisits it. Rows of one id and payload:
one of them is the response, the others revisit it. Payloads under ``least``
bytes: always responses. Empty table: no archive, empty result. Columns other
than those named are not looked at. A stream that ends inside a record, or holds
something else than records, raises.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as tk
from lexiloom.llm.scratch import Scratch
from lexiloom.llm.spread import left_join_grouped

ARCHIVE_BYTES = 128 << 20
ARCHIVE_RECORDS = 100_000
#: Archives are dealt evenly to so many tasks at most.
TASKS = 20_000
LEAST = 100
CHUNK = 1 << 20
_SCHEME = "urn:x-row:"
_END = b"\r\n\r\n"


def _open(uri: str, mode: str):
    # Hadoop's names of a scheme that pyarrow knows by another.
    system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def _record(kind: str, rid: str, url: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record of the writer's own with its closing lines."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{_SCHEME}{rid}>\r\nWARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def _as_revisit(head: bytes, block: bytes, refers: str, digest: str) -> bytes:
    """The record as a revisit: its own head and HTTP head, without the payload."""
    http = block.partition(_END)[0] + _END
    replaced = (b"warc-type", b"content-length", b"warc-profile", b"warc-refers-to", b"warc-payload-digest", b"warc-block-digest", b"warc-truncated")
    first, *lines = head.split(b"\r\n")
    kept = [x for x in lines if x.partition(b":")[0].strip().lower() not in replaced]
    more = f"WARC-Type: revisit\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{_SCHEME}{refers}>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(http)}"
    return b"\r\n".join([first, *kept, more.encode()]) + _END + http + _END


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or of many, in pieces of bounded size."""
    inflate = zlib.decompressobj(31)
    data = stream.read(CHUNK)
    while data:
        out = inflate.decompress(data, CHUNK)
        if out:
            yield out
        if inflate.eof:
            data = inflate.unused_data or stream.read(CHUNK)
            inflate = zlib.decompressobj(31)
        else:
            data = inflate.unconsumed_tail or stream.read(CHUNK)
    tail = inflate.flush()
    if tail:
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Head, its fields (names in lower case) and block of each record of a stream; raises on one that is cut off."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        # Closing lines belong to the record before; some writers end the last one short.
        while need(1) and held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            return
        seen = 0
        while (end := held.find(_END, seen)) < 0:
            seen = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("a WARC record is cut off in its head")
        head = bytes(held[:end])
        fields = fields_of(head)
        if not head.startswith(b"WARC/") or "content-length" not in fields:
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        stop = end + 4 + int(fields["content-length"])
        if not need(stop):
            raise ValueError("a WARC record is cut off in its block")
        yield head, fields, bytes(held[end + 4 : stop])
        del held[:stop]


def fields_of(head: bytes) -> dict[str, str]:
    """The named fields below the first line of a head; a line that begins with white space goes on the one before."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _unchunked(body: bytes) -> bytes:
    """A body without the framing of chunks; as it is if it is not framed so after all."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(;.*)?", body[at:end], re.S) if end >= 0 else None
        if size is None:
            return body
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """What a record is about, or None for records that only describe others."""
    kind = fields.get("warc-type", "")
    if kind in ("resource", "conversion"):
        return block
    if kind != "response":
        return None
    if not fields.get("content-type", "").startswith("application/http"):
        return block
    head, _, body = block.partition(_END)
    return _unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


_INDEX = "archive string, seq long, id long, digest string, bytes long"


def _writer(folder: str, most: int, records_most: int):
    def run(batches):
        out = None
        held: list[tuple] = []

        def close():
            out.write(deflate.flush())
            out.close()
            cols = list(zip(*held, strict=True))
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["archive", "seq", "id", "digest", "bytes"])

        filled = 0
        for batch in batches:
            data, bounds = tk.text_bytes(batch.column("payload"))
            flat, at = memoryview(np.ascontiguousarray(data)), bounds.tolist()
            for k, (rid, url) in enumerate(zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), strict=True)):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, deflate, filled = _open(name, "w"), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                payload = bytes(flat[at[k] : at[k + 1]])
                digest = hashlib.sha256(payload).hexdigest()
                out.write(deflate.compress(_record("response", "null" if rid is None else str(rid), url, digest, len(payload), payload)))
                held.append((name, len(held), rid, digest, len(payload)))
                filled += len(payload)
                if filled >= most or len(held) >= records_most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(scratch: Scratch, rows: DataFrame, most: int = ARCHIVE_BYTES, records_most: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write ``rows`` (id, url, payload) as monolithic gzip archives; the index of what they hold."""
    return scratch.write(rows.select("id", "url", "payload").mapInArrow(tk.lean(_writer(scratch.folder("raw"), most, records_most)), _INDEX), "raw-index")


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """archive, seq and refers of the records that repeat the payload of one with a smaller id."""
    at = F.struct("id", "archive", "seq")
    large = index.filter(F.col("bytes") >= least)
    groups = large.groupBy("digest").agg(F.min(F.when(F.col("id").isNotNull(), at)).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1 AND first IS NOT NULL")
    joined = left_join_grouped(large.select("digest", "archive", "seq", "id"), groups, ["digest"], "n", large.count()).filter("first IS NOT NULL")
    return joined.filter(~at.eqNullSafe(F.col("first"))).select("archive", "seq", F.col("first.id").alias("refers"))


def normalise(source: str, target: str, turn: dict[int, int] | None = None) -> dict:
    """Inflate the archive ``source`` once; write its records as members of ``target`` and the index beside it.

    ``turn`` has the records, by number, that become revisits of an id.
    """
    turn, offset, n = turn or {}, 0, 0
    with _open(source, "r") as raw, _open(target, "w") as out, _open(target + ".idx", "w") as index:
        for n, (head, fields, block) in enumerate(records(inflated(raw)), 1):
            payload, refers = payload_of(fields, block), turn.get(n - 1)
            digest = None if payload is None else hashlib.sha256(payload).hexdigest()
            record = head + _END + block + _END if refers is None else _as_revisit(head, block, str(refers), digest)
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = deflate.compress(record) + deflate.flush()
            out.write(member)
            entry = {
                "offset": offset, "length": len(member), "type": fields.get("warc-type") if refers is None else "revisit", "id": fields.get("warc-record-id", "").strip("<>"),
                "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "digest": digest, "bytes": None if payload is None else len(payload),
            }
            index.write((json.dumps(entry) + "\n").encode())
            offset += len(member)
    return {"archive": target, "records": n, "bytes": offset}


def entries(archive: str) -> list[dict]:
    """The index beside a normalised archive."""
    with _open(archive + ".idx", "r") as index:
        return [json.loads(x) for x in index.read().decode().splitlines()]


def read_member(archive: BinaryIO, entry: dict) -> dict:
    """The index entry with head, fields, block, payload and refers_to of its record; a payload is checked against the digest."""
    archive.seek(entry["offset"])
    head, fields, block = next(records(iter([zlib.decompress(archive.read(entry["length"]), 31)])))
    payload = payload_of(fields, block)
    if payload is not None and (len(payload) != entry["bytes"] or hashlib.sha256(payload).hexdigest() != entry["digest"]):
        raise ValueError(f"record {entry['id']} does not match its digest")
    refers = fields.get("warc-refers-to")
    return entry | {"head": head, "fields": fields, "block": block, "payload": payload, "refers_to": refers and refers.strip("<>")}


def _normaliser(folder: str):
    def run(batches):
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                done.append(normalise(row["archive"], f"{folder}/{uuid.uuid4().hex}.warc.gz", {x["seq"]: x["refers"] for x in row["turn"] or []}))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in (("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()))], ["archive", "records", "bytes"])

    return run


def normalise_files(archives: DataFrame, folder: str) -> DataFrame:
    """archive, records and bytes of the normalised form, in ``folder``, of each of ``archives`` (archive, turn or not)."""
    rows = archives.withColumn("turn", F.lit(None).cast("array<struct<seq:long,refers:long>>")) if "turn" not in archives.columns else archives
    tasks = max(1, min(TASKS, rows.count()))
    return rows.select("archive", "turn").repartition(tasks).mapInArrow(tk.lean(_normaliser(folder)), "archive string, records long, bytes long")


_ROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _row_number(rid: str | None) -> int | None:
    number = (rid or "null").removeprefix(_SCHEME)
    return None if number == "null" else int(number)


def _reader(batches):
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            index = entries(name)
            with _open(name, "r") as archive:
                for lo in range(0, len(index), 4096):
                    read = (read_member(archive, e) for e in index[lo : lo + 4096])
                    cols = list(zip(*((_row_number(r["id"]), r["bytes"], r["digest"], r["type"], r["refers_to"] and _row_number(r["refers_to"])) for r in read), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _ROW, strict=True)], [k for k, _ in _ROW])


def archive_and_read(spark: SparkSession, rows: DataFrame, least: int = LEAST, most: int = ARCHIVE_BYTES, records_most: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write ``rows`` (id, url, payload), normalise the archives, and read every record back through its index."""
    scratch = Scratch(spark, "warc")
    index = write_archives(scratch, rows, most, records_most)
    # An archive's own records bound what is gathered for it.
    turns = revisits(index, least).groupBy("archive").agg(F.collect_list(F.struct("seq", "refers")).alias("turn"))
    archives = scratch.write(index.select("archive").distinct().join(turns, "archive", "left"), "archives")
    done = scratch.write(normalise_files(archives, scratch.folder("records")), "manifest")
    scratch.keep_only("records", "manifest")
    tasks = max(1, min(TASKS, done.count()))
    return done.select("archive").repartition(tasks).mapInArrow(tk.lean(_reader), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC records and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive_and_read(spark, pages.select(F.col("page_id").cast("long").alias("id"), "url", F.col("html").alias("payload")))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
