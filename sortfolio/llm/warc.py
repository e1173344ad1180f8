"""WARC archives compressed record by record with a Zstandard dictionary that the archive itself carries.

Writing: payload digests decide which record of equal payloads is the response (smallest key) and which are revisits; each
partition then becomes one archive: a leading skippable frame with the dictionary, a ``warcinfo`` record, and one frame per
record. Spark's text writer puts the frames into files, with an empty skippable frame as its line separator: archives are
committed like any Spark output, reach every file system that Spark reaches, and stay valid Zstandard files.

The dictionary is trained on a bounded sample of records (``SAMPLE_ROWS`` by the hash of the key, ``SAMPLE_BYTES`` of each).

Reading: ``read_warc`` parses archives frame by frame with the dictionary found in them.

Defined cases: a null payload is empty; payloads below ``least_bytes`` are never revisits; a null key orders first; repeated
rows are repeated records (equal keys: one of them is the response, the others revisit it); very long payloads are one record;
an empty table gives an archive-free folder and no rows; columns other than key, url and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortfolio.llm.storage import land, shared_folder

SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 2000, 4096, 1 << 16
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DICT_MAGIC = 0x184D2A5D  # skippable frame that carries a dictionary
_SKIPPABLE = "<II"  # magic number and size
#: an empty skippable frame; the text writer's line separator
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], body: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = {"WARC-Record-ID": _record_id(page, digest), "WARC-Date": _DATE, "WARC-Target-URI": _clean(url),
               "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
               "X-Page-Id": "" if page is None else str(page), "X-Payload-Bytes": str(len(payload))}
    if not revisit:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page": "" if refers_to is None else str(refers_to)}
    return record("revisit", headers, http)


def train_dictionary(pages: DataFrame, key: str, url: str, payload: str) -> bytes:
    """A dictionary from a bounded sample; without enough material, the sampled records themselves."""
    step = max(1, pages.count() // SAMPLE_ROWS)
    # a limit, not an order: no task sends more than the sample, and the driver gets no more than that in all
    rows = (pages.where(F.pmod(F.xxhash64(F.col(key).cast("string"), url), F.lit(step)) == 0)
            .select(F.col(key).alias("k"), F.col(url).alias("u"), F.substring(F.col(payload), 1, SAMPLE_BYTES).alias("p"))
            .limit(SAMPLE_ROWS).collect())
    records = [page_record(r.k, r.u, p, payload_digest(p), None, False) for r in rows for p in [(r.p or "").encode()]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICT_BYTES]


def marked_revisits(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """``(key, url, payload, digest, revisit, refers_to, row)``: the smallest key of equal payloads is their response."""
    rows = land(pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
                .withColumn("digest", F.sha1(F.encode("payload", "UTF-8"))).withColumn("row", F.monotonically_increasing_id()), "pages")
    lead = F.min(F.struct("page", "row"))
    firsts = land(rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(lead.alias("lead"), F.count("*").alias("n"))
                  .where("n > 1").select("digest", F.col("lead.page").alias("first"), F.col("lead.row").alias("first_row")), "firsts")
    # only the narrow columns of repeated payloads meet; most payloads never move
    again = land(rows.where(F.octet_length("payload") >= least_bytes).select("row", "digest").join(firsts, "digest")
                 .where("row <> first_row").select("row", F.col("first").alias("refers_to"), F.lit(True).alias("revisit")), "again")
    return rows.join(again, "row", "left").select(
        "page", "url", "payload", "digest", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to", "row")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> None:
    """Write an archive per partition of about ``ARCHIVE_BYTES`` of payload into the folder ``path``."""
    spark = pages.sparkSession
    marked = marked_revisits(pages, key, url, payload, least_bytes)
    sent = spark.sparkContext.broadcast(train_dictionary(pages, key, url, payload))
    total = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    files = max(1, -(-total // ARCHIVE_BYTES), min(spark.sparkContext.defaultParallelism, total >> 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, fresh = sent.value, True
        compressor = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        frames: list[bytes] = []
        size = 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            if fresh and cols[0]:
                info = record("warcinfo", {"WARC-Record-ID": _record_id("info", hashlib.sha1(raw).hexdigest()), "WARC-Date": _DATE,
                                           "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                frames += [struct.pack(_SKIPPABLE, DICT_MAGIC, len(raw)) + raw, compressor.compress(info)]
                fresh = False
            for page, link, text, hexed, revisit, refers_to in zip(*cols):
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                frames.append(compressor.compress(page_record(page, link, text.encode(), digest, refers_to, revisit)))
                size += len(frames[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                    frames, size = [], 0
        if frames:
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    # by the landed row's number: rows that share key and url are dealt out too
    dealt = marked.repartition(int(files), "row").drop("row")
    (dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
     .write.option("lineSep", SEPARATOR).option("compression", "none").text(path))


def frames(content: bytes) -> Iterator[bytes]:
    """Records of an archive, decompressed with the dictionary that leads it."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        magic, size = struct.unpack_from(_SKIPPABLE, view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC and size:
                dictionary = zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        stream = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, step = [], 1 << 13
        while not stream.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the archive ends inside a frame")
            parts.append(stream.decompress(piece))
            at += len(piece)
        at -= len(stream.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)`` of all pages in the archives of a folder.

    A response's bytes and digest are taken from the payload that was read, and the digest must equal the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: int(x) if x else None
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for raw in frames(content.as_buffer()):
                    h, body = parse(raw)
                    kind = h["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest, length = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                    if payload is not None and (payload_digest(payload) != digest or len(payload) != length):
                        raise ValueError(f"payload and digest differ: {h['WARC-Record-ID']}")
                    rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], kind, number(h.get("X-Refers-To-Page")), length, digest, payload))
                    size += len(raw)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(
        run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_warc(pages, path, key, url, payload, least_bytes)
    return read_warc(pages.sparkSession, path)
