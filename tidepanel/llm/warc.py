"""WARC archives whose records are compressed one by one with a shared dictionary.

Every task writes archives of a bounded size. For each it builds a Zstandard
dictionary from records evenly spaced over the archive (at most ``sample_records``
and ``sample_bytes``: a documented bound, the rest of the data isn't needed for
it), stores it in a leading skippable frame, and compresses each record into a
frame of its own, so that a record can be read from its offset alone.

Of records with equal payloads the one with the largest page id is a response, the
others are revisits that refer to it and hold no payload. Copies are found from
digests alone; the payloads are not shuffled unless there are over BROADCAST_ROWS
revisits.

Archives go to the shared folder, under a new name in every attempt of a task; the
manifest names only those of attempts that succeeded, and only these are read.

A null html is an empty payload, and empty payloads count as equal. A null page id
is smaller than all others. Rows equal in id and payload are equal records: all
are responses, or all revisits. A null url is left out. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import written

ARCHIVE_BYTES = 32 << 20
SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
BROADCAST_ROWS = 500_000
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _dictionary(records: list[bytes], sample_records: int, sample_bytes: int, size: int) -> zstandard.ZstdCompressionDict:
    step = max(1, len(records) // sample_records)
    most = max(1024, sample_bytes // max(1, min(len(records), sample_records)))
    samples = [r[:most] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples)
    except (zstandard.ZstdError, ValueError):  # too few or too even records: their bytes serve as they are
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}" if m[0] != "%" else "%", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archive(records: list[bytes], folder: str, sample_records: int, sample_bytes: int, size: int, level: int) -> tuple[str, int, int]:
    words = _dictionary(records, sample_records, sample_bytes, size)
    pack = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True)
    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    files, place = FileSystem.from_uri(path)
    files.create_dir(place.rsplit("/", 1)[0], recursive=True)
    raw, n = words.as_bytes(), 0
    with files.open_output_stream(place) as out:
        n += out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        for r in records:
            n += out.write(pack.compress(r))
    return path, len(records), n


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int, date: str, options: tuple):
    waiting, size, done = [], 0, []
    for batch in batches:
        for page_id, url, html, refers_to, again in zip(*(c for c in batch.columns)):
            payload = (html.as_py() or "").encode()
            waiting.append(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), bool(again.as_py()), date))
            size += len(waiting[-1])
            if size >= archive_bytes:
                done.append(_archive(waiting, folder, *options))
                waiting, size = [], 0
    if waiting:
        done.append(_archive(waiting, folder, *options))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "n_records", "n_bytes"])


def write(
    pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
    sample_records: int = 256, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3,
) -> DataFrame:
    """Write a record for each row of page_id, url, html; returns the manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    copies = rows.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    again = rows.select("page_id", "sha").join(copies, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = written(again.withColumn("again", F.lit(True)), "revisits")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    same = rows["page_id"].eqNullSafe(side["page_id"]) & (rows["sha"] == side["sha"])
    full = rows.join(side, same, "left").select(rows["page_id"], "url", "html", "refers_to", "again")
    options = (sample_records, sample_bytes, dictionary_bytes, level)
    return written(full.mapInArrow(lambda b: _write(b, folder, archive_bytes, date, options), MANIFEST), "manifest")


def _frames(path: str, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, streamed."""
    files, place = FileSystem.from_uri(path)
    with files.open_input_stream(place) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} doesn't start with a dictionary")
        raw = source.read(size)
        kind = zstandard.DICT_TYPE_AUTO
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
        rest = source.read(piece)
        while rest:
            one, out = unpack.decompressobj(), []
            while True:
                out.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data or source.read(piece)
                    break
                rest = source.read(piece)
                if not rest:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(out)


def _parsed(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or _digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), fields.get("WARC-Target-URI"), kind, n, digest, number("X-Refers-To-Page-Id"), payload if kind == "response" else None


def _read(batches: Iterator[pa.RecordBatch], batch_bytes: int):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            for raw in _frames(path):
                rows.append(_parsed(raw))
                size += len(raw)
                if size >= batch_bytes:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def read(manifest: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """The records of all archives of a manifest; payload is null for revisits."""
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(lambda b: _read(b, batch_bytes), RECORDS)
