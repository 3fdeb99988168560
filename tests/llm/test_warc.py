import base64
import hashlib
import struct

import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from tidepanel.llm import warc
from tidepanel.llm.common import new_path

SCHEMA = "page_id long, url string, html string, sha string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write(df, new_path(spark, "warc"), **options)
    return manifest, warc.read(manifest, batch_bytes=2000).collect()


def test_round_trip_and_revisits(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i} " + "word é " * (i % 50) + "</p>", "") for i in range(300)]
    rows += [(1000 + i, None, "<p>copy</p>", "") for i in range(40)] + [(2000, "u\r\nX: y", None, ""), (2001, "", "", ""), (2002, "", "x\r\n\r\ny" * 99, "")]
    manifest, got = run(spark, rows, archive_bytes=20_000)
    payload = {i: html or "" for i, _, html, _ in rows}
    assert len(got) == len(rows) and manifest.agg(F.sum("n_records")).first()[0] == len(rows) and manifest.count() > 3
    for r in got:
        same = [i for i in payload if payload[i] == payload[r.page_id]]
        assert r.payload_bytes == len(payload[r.page_id].encode()) and r.payload_digest == digest(payload[r.page_id])
        if r.page_id == max(same):
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload).decode() == payload[r.page_id]
        else:
            assert r.record_type == "revisit" and r.refers_to == max(same) and r.payload is None
    assert {r.page_id: r.url for r in got}[2000] == "u%0D%0AX: y"


def test_layout_of_an_archive(spark):
    manifest, _ = run(spark, [(i, "u", f"<p>{i}</p>" * 30, "") for i in range(100)])
    files, place = FileSystem.from_uri(manifest.first().path)
    raw = files.open_input_stream(place).read()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
    first = one.decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and one.unused_data  # a frame of its own


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(5, "u", "same", ""), (5, "u", "same", ""), (None, "u", "same", ""), (7, None, "other", "")]
    _, got = run(spark, rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "revisit", 5), (5, "response", None), (5, "response", None), (7, "response", None),
    ]
    assert run(spark, [])[1] == []
