"""WARC archives: written with one gzip member for each record, and read again sequentially.

Spark works out the digests and, of equal payloads of at least `least` bytes, which record is the response and which ones
revisit it. Python workers write one archive for each partition to the shared folder, under a name of its own, and report
the name; only archives that a committed task reported are read, so attempts that were lost or repeated don't show.

The reader keeps one chunk and one record in memory. It inflates member after member incrementally, takes a block by its
Content-Length, and verifies block and payload digests; what is malformed or doesn't match raises ValueError.

Defined results: null html is the empty payload; a null url gives a record without target; rows with equal ids are written
each, and among equal payloads all rows of the largest id are responses; null ids rank below all others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumeno.llm.common import lookup, scratch, written

LEAST = 1000
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record; a revisit has the payload's digest and size but not the payload."""
    block = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: {sha1_field(payload)}", f"WARC-Block-Digest: {sha1_field(block)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(f: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The inflated content of each gzip member."""
    data, z, parts = b"", None, []
    while True:
        if not data:
            data = f.read(chunk)
            if not data:
                break
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = None, []
    if z is not None:
        raise ValueError("the archive ends within a member")


def records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, verified."""
    for data in members(f):
        head, sep, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not sep or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(h["content-length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"{h.get('warc-record-id')}: its length is not {n}")
        for field in ("warc-block-digest", *["warc-payload-digest"] * (h["warc-type"] == "response")):
            if field in h and sha1_field(block) != h[field]:
                raise ValueError(f"{h.get('warc-record-id')}: {field} doesn't match")
        yield h, block


def decide(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 1_000_000) -> DataFrame:
    """page_id, url, html, _response: the id of the response that a page revisits, and _again, whether it does.

    The largest id of each digest is found by parts (a digest's pages are dealt to SALTS of them), then over the parts, and
    goes back to each part; a payload that a third of all pages share is never in one task. At most `most` revisits are
    broadcast; more are joined by shuffle.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("_d", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    small = base.select("page_id", "_d").where(F.col("_d").isNotNull())
    tops = small.groupBy("_d").agg(F.max("page_id").alias("_response"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = written(lookup(small, "_d", tops, F.col("page_id")).where(F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))).select(F.col("page_id").alias("_p"), F.col("_d").alias("_e"), "_response").distinct(), "revisits")
    again = F.broadcast(again) if again.limit(most + 1).count() <= most else again
    joined = base.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_d") == F.col("_e")), "left")
    return joined.select("page_id", "url", "html", "_response", F.col("_e").isNotNull().alias("_again"))


def urn(page_id: str | None) -> str:
    """The record id of a page, percent-encoded; an empty id differs from none."""
    return "urn:x-none" if page_id is None else "urn:x-page:" + quote(page_id, safe="")


def page_of(record_id: str) -> str | None:
    name = record_id.strip("<>")
    return None if name == "urn:x-none" else unquote(name.removeprefix("urn:x-page:"))


def write(decided: DataFrame, path: str) -> DataFrame:
    """Writes an archive for each partition below path; returns a table of the names (file) and numbers of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name, n = f"{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in batches:
                for k in range(batch.num_rows):
                    page, url, html, response, again = (batch.column(c)[k].as_py() for c in range(5))
                    payload = html.encode("utf-8", "surrogatepass")
                    out.write(member(record("revisit" if again else "response", urn(page), url, payload, urn(response) if again else None)))
                    n += 1
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n]})

    text = decided.select(F.col("page_id").cast("string"), "url", "html", F.col("_response").cast("string"), "_again")
    return written(text.mapInArrow(run, "file string, n_records long"), "archives")


def read(archives: DataFrame, path: str, id_type: str = "bigint", batch_rows: int = 2000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives, a task for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as f:
                    for h, block in records(f):
                        found += 1
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = len(block) if h["warc-type"] == "response" else int(h["x-payload-length"])
                        rows.append((page_of(h["warc-record-id"]), size, digest, h["warc-type"], page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None))
                        if len(rows) >= batch_rows:
                            yield made()
                if found != n:
                    raise ValueError(f"{name} has {found} records, not {n}")
        if rows:
            yield made()

    # The number is given, as adaptive execution would bring the short names of all archives to one task.
    dealt = archives.repartitionByRange(max(1, archives.count()), "file")
    made = dealt.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return made.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes all pages as WARC records and reads the archives back."""
    path = scratch(pages.sparkSession, "warc")
    return read(write(decide(pages, least), path), path, pages.schema["page_id"].dataType.simpleString())
