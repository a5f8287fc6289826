"""WARC archives: writing pages as response and revisit records, and a splittable reader.

Each record is a gzip member of its own. A reader task gets a byte range of an archive, looks for
the gzip magic, and takes a candidate for a member only if its beginning decodes to a WARC header
and the member ends where the file ends or another member starts. It owns the records that start
inside its range and reads past the end of the range to finish the last one.

Archives lie in the cluster's shared folder and are opened with ``pyarrow.fs``, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import slices, saved, scratch_path

_MAGIC = b"\x1f\x8b\x08"
_AHEAD = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
RECORDS = "path string, offset long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary, intact boolean"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """The bytes of one record, uncompressed. A revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 1000, salts: int = 32) -> DataFrame:
    """page_id, url, payload and refers_to: the largest page_id with an equal payload, for the others.

    Groups are counted on digests alone, combined before the shuffle. Only pages of
    ``least_bytes`` or more look for theirs (a page without id refers to the largest id, if there is
    one), and each group is there ``salts`` times, so that the
    pages of one payload are spread over as many tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    large = F.octet_length("payload") >= least_bytes
    digests = rows.where(large).select("page_id", F.sha1("payload").alias("_digest"), F.octet_length("payload").alias("_bytes"))
    groups = digests.groupBy("_digest", "_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.where(large).withColumns({"_digest": F.sha1("payload"), "_bytes": F.octet_length("payload"), "_salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")})
    found = keyed.join(groups, ["_digest", "_bytes", "_salt"], "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))
    return found.unionByName(rows.where(~large).withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType)))


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, roll_bytes: int = 256 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; returns the manifest (path, bytes, records).

    Every task attempt writes files of its own name, and only those of the attempt that succeeded
    are in the manifest, so a lost executor leaves no record twice. Null html is an empty payload.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, size, n = None, [], 0, 0
        for batch in batches:
            for row in (r for part in slices(batch, "payload", 200) for r in part.to_pylist()):
                if out is None or size >= roll_bytes:
                    if out is not None:
                        out.close()
                        done.append((name, size, n))
                    name, size, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _member(record(row["page_id"], row["url"], row["payload"], row["refers_to"], date), level)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{d[0]}" for d in done], "bytes": [d[1] for d in done], "records": [d[2] for d in done]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return saved(with_revisits(pages, least_bytes).mapInArrow(write, MANIFEST), "warc-manifest")


def _parse(data: bytes) -> dict | None:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(named.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {"headers": named, "payload": payload, "http_length": length}


def records_in_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in [start, end).

    The range is held for the search. What a record has beyond it is read a piece at a time and goes
    straight to the decompressor, so a long record costs its own length once.
    """
    data = file.read_at(min(end + len(_MAGIC), size) - start, start)
    stop, at = start + len(data), 0

    def piece(place: int) -> bytes:
        """Some bytes from a place in the file; empty at its end."""
        if place < stop:
            return data[place - start : place - start + 65536]
        return file.read_at(min(_AHEAD, size - place), place) if place < size else b""

    while True:
        at = data.find(_MAGIC, at)
        if at < 0 or start + at >= end:
            return
        unpack, parts, place, head, valid = zlib.decompressobj(31), [], start + at, b"", True
        try:
            while not unpack.eof:
                chunk = piece(place)
                if not chunk:
                    raise zlib.error("cut short")
                place += len(chunk)
                parts.append(unpack.decompress(chunk))
                if len(head) < 7:
                    head += parts[-1][:7]
                    if not b"WARC/1.".startswith(head[:7]):
                        raise zlib.error("no WARC header")
            close = place - len(unpack.unused_data)
            follows = piece(close)[:3]
            # What follows a record is another member, the end, or filling that holds no member's header.
            valid = follows in (b"", _MAGIC) or (len(follows) < 3 and _MAGIC.startswith(follows)) or _parse(b"".join(parts)) is not None
        except zlib.error:
            valid = False
        found = _parse(b"".join(parts)) if valid else None
        if found:
            yield start + at, found
            at = close - start
        else:
            at += 1


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``manifest`` (path, bytes), read in ranges of ``split_bytes``.

    Digest and length of a response are taken from its payload (``intact``: the header agrees), of
    a revisit from its header. An empty manifest gives no records.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    spread = ranges.repartition(max(1, min(20_000, ranges.count())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())])
        for batch in batches:
            for r in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for offset, found in records_in_range(file, r["bytes"], r["start"], min(r["start"] + split_bytes, r["bytes"])):
                        named, payload = found["headers"], found["payload"]
                        stated = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in named else None
                        response = named.get("warc-type") == "response"
                        digest = hashlib.sha1(payload).hexdigest() if response else stated
                        rows.append((r["path"], offset, named.get("warc-record-id"), named.get("warc-type"), named.get("warc-target-uri"), named.get("warc-refers-to"), digest, len(payload) if response else found["http_length"], payload if with_payload else None, digest == stated))
                        held += len(payload) if with_payload else 0
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spread.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Page ids are taken from the record ids; a null id comes back as null, repeated rows come back
    as often as they went in (copies of the largest id are all responses).
    """
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as long)")
    records = read_archives(write_archives(pages, least_bytes=least_bytes), with_payload=False)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "intact")
