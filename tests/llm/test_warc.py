from __future__ import annotations

import base64
import glob
import hashlib
import os

import zstandard
from pyspark.sql import functions as F

from sortfolio.llm import warc
from sortfolio.llm.storage import shared_folder

PAGES = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (7, "http://c", ""), (8, "u\r\nX: y", "é" * 30000),
         (10, "http://d", "P*M\x18\x00\x00\x00\x00"), (11, "http://d", "a\r\n\r\nb"), (3, "http://b", "<p>x</p>")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, row bigint, digest string")


def expected(rows):
    out, first = [], {}
    for i, (page, _, html) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        body = (html or "").encode()
        revisit = body in first
        first.setdefault(body, page)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES)
    bodies = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(bodies[p] == (h or "").encode() for p, _, h in PAGES if p in bodies)


def test_small_payloads_are_all_responses(spark):
    got = warc.round_trip(pages(spark, PAGES), least_bytes=9).collect()
    assert {r.record_type for r in got} == {"response"}


def test_archives_lead_with_their_dictionary_and_are_plain_zstandard(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i % 50} of many</p></body></html>" * 5) for i in range(300)]
    path = shared_folder(spark, "archives")
    warc.write_warc(pages(spark, rows), path)
    files = [f for f in glob.glob(f"{path}/part-*")]
    assert files
    for f in files:
        content = open(f, "rb").read()
        if not content:
            continue
        magic, size = int.from_bytes(content[:4], "little"), int.from_bytes(content[4:8], "little")
        assert magic == warc.DICT_MAGIC
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content, read_across_frames=True) as r:
            assert r.read() == b"".join(warc.frames(content))


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_rows_without_key_and_url_make_several_archives(spark, monkeypatch):
    """100,000 rows that differ in nothing but a short payload are dealt out, and all come back."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 19)
    rows = spark.range(100_000).select(F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(
        F.lit("<p>some payload of a page "), F.col("id").cast("string")).alias("html"))
    path = shared_folder(spark, "archives")
    warc.write_warc(rows, path)
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path}/part-*")]
    assert len(sizes) >= 6 and max(sizes) < 3 * min(sizes)
    assert warc.read_warc(spark, path).select("payload").distinct().count() == 100_000
