"""WARC archives compressed record by record with a Zstandard dictionary.

A dictionary is trained on a bounded sample of payloads. Each archive file starts with a skippable frame that holds it, and
every record is a Zstandard frame of its own, so a record can be read from its offset with the dictionary alone. Files are
written and read by Spark's own writers and readers, so they can lie in any store that Spark reaches: a line of the text
writer carries the raw bytes, and the line feed that it adds is the content of a closing skippable frame of one byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import pieces, shared_folder, table

SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_FILLER = 0x184D2A50
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 500  # payloads the dictionary is trained on
SAMPLE_BYTES = 16 << 10  # of each
FILE_BYTES = 64 << 20  # of payload in an archive file, roughly
LINE_BYTES = 1 << 20
LEVEL = 3
LEAST_REVISIT = 0  # payloads of fewer bytes are never revisits
DATE = "2024-01-01T00:00:00Z"
HEADER = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")


def _skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; the samples themselves (raw content) where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to is set) names the response and carries no payload."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {name(refers_to)}",
            f"X-Payload-Length: {len(payload)}",
        ]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive."""
    if not content:
        return
    if int.from_bytes(content[:4], "little") != SKIPPABLE_DICTIONARY:
        raise ValueError("the archive does not start with a dictionary frame")
    size = int.from_bytes(content[4:8], "little")
    reader = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(content[8 : 8 + size])).stream_reader(
        content[8 + size :], read_across_frames=True
    )
    rest = b""
    while True:
        while b"\r\n\r\n" not in rest:
            more = reader.read(1 << 16)
            if not more:
                if rest:
                    raise ValueError("the archive ends within a record")
                return
            rest += more
        head, rest = rest.split(b"\r\n\r\n", 1)
        headers = {k.decode(): v.decode() for k, v in HEADER.findall(head + b"\r\n")}
        need = int(headers["Content-Length"]) + 4
        parts, have = [rest], len(rest)
        while have < need:
            more = reader.read(max(1 << 16, need - have))
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(more)
            have += len(more)
        rest = b"".join(parts)
        yield headers, rest[: need - 4]
        rest = rest[need:]


def _archive(dictionary: bytes, least: int, most_lines: int):
    """Lines of archive files: a dictionary frame, then frames of records, each line closed by a filler frame.

    Every most_lines lines a new file begins, with its own dictionary frame.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for number, batch in enumerate(pieces(batches, "html", LINE_BYTES)):
            line = [] if number % most_lines else [_skippable(SKIPPABLE_DICTIONARY, dictionary)]
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                first = row["first"]
                revisit = first is not None and row["page_id"] != first and len(payload) >= least
                sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                line.append(packer.compress(record(row["page_id"], row["url"], payload, sha, first if revisit else None)))
            line.append(SKIPPABLE_FILLER.to_bytes(4, "little") + (1).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(line)], pa.binary())], names=["line"])

    return rows


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write a record for each page to archive files under path.

    pages: page_id, url, html; other columns are ignored. Null html is an empty payload. Of records with equal payloads of
    at least `least` bytes the one with the smallest page_id is the response, and so are rows that repeat its id; the
    others revisit it. Rows without an id revisit it too, or are responses if no row with that payload has an id.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("first"))
    count = pages.where("html is not null").count()
    # About twice as many as needed pass the threshold, so few rows are sorted and none of the others' text is.
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, count))
    drawn = (
        pages.where("html is not null")
        .select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("part"))
        .withColumn("draw", F.xxhash64("page_id", "url"))
        .where(F.col("draw") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
        .orderBy("draw", "page_id")
        .limit(SAMPLE_ROWS)
        .collect()
    )
    dictionary = train_dictionary([r["part"].encode() for r in drawn if r["part"]])
    # The only shuffle of the pages; a payload that very many pages share is split by the skewed join.
    lines = rows.join(first, "sha").select("page_id", "url", "html", "sha", "first")
    most_lines = max(1, FILE_BYTES // LINE_BYTES)
    lines = lines.mapInArrow(_archive(dictionary, least, most_lines), "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.mode("errorifexists").option(
        "maxRecordsPerFile", most_lines
    ).text(path)


RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for headers, payload in read_records(content.as_py()):
                kind, sha = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != sha:
                    raise ValueError(f"{headers['WARC-Record-ID']} does not match its digest")
                rows.append(
                    {
                        "page_id": _page(headers["WARC-Record-ID"]),
                        "url": headers["WARC-Target-URI"],
                        "payload_bytes": len(payload) if kind == "response" else int(headers["X-Payload-Length"]),
                        "payload_digest": sha,
                        "record_type": kind,
                        "refers_to": _page(headers.get("WARC-Refers-To")),
                        "payload": payload if kind == "response" else None,
                    }
                )
                size += len(payload) + 200
                if size > LINE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits) of each record.

    A payload that does not match its digest, or an archive that is cut off, is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        _record_rows,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
