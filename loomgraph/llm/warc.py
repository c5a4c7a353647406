"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writer.  Payloads are compared by SHA-1 and length; of equal ones, the record with the
largest id carries the payload, the others are revisit records that name it.  A task
writes its records, a gzip member each, to a file of its own and then reports it; a
repeated task writes another file, and only reported files are read.

Reader.  Each archive is parsed member by member (or, uncompressed, record by record).
Where a check fails (gzip CRC, version line, header, length, block digest), the reader
looks for the next byte place where a whole record can be read, gives the records from
there on, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table

ARCHIVE_BYTES = 32 << 20
MIN_PAYLOAD = 0
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STAMP = "1970-01-01T00:00:00Z"
_WINDOW = 1 << 13


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _urn(page_id) -> str:
    """A null id is ``None``; in others, what can't stand in a header is percent-encoded."""
    return f"<urn:page:{_quoted(str(page_id))}>"


def _quoted(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>%]", lambda m: f"%{ord(m[0]):02X}", text)


def _safe(url: str | None) -> str:
    """A header value: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page:unknown"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One record as a gzip member; ``refers_to`` makes it a revisit, which carries no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_STAMP}",
        f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    whole = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(whole) + squeeze.flush()


class Damaged(ValueError):
    pass


def _parse(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """A record that starts at ``at`` of uncompressed bytes, and the place after it."""
    if raw[at : at + len(_VERSION)] != _VERSION:
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header without end")
    fields = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (length := fields.get("content-length", "")).isdigit():
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(length)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record doesn't end at its length")
    block = raw[start:stop]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": int(size[1]) if size else len(payload), "payload": payload,
    }, stop + 4


def _member(raw: memoryview, at: int) -> tuple[bytes, int]:
    inflate, parts, to = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and to < len(raw):  # by windows: what is unused gets copied
            parts.append(inflate.decompress(raw[to : to + _WINDOW]))
            to += _WINDOW
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not inflate.eof:
        raise Damaged("gzip member without end")
    return b"".join(parts), min(to, len(raw)) - len(inflate.unused_data)


def _read_at(raw: bytes, view: memoryview, at: int) -> tuple[list[dict], int]:
    """The record that starts at ``at``, or all records of the gzip member that does, and the place after."""
    if raw[at : at + 3] != _MAGIC:
        record, after = _parse(raw, at)
        return [record], after
    whole, after = _member(view, at)
    records, used = [], 0
    while used < len(whole) or not records:
        record, used = _parse(whole, used)
        records.append(record)
    return records, after


def salvage(raw: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """``("record", start, end, fields)`` and ``("gap", start, end, reason)`` in order; their spans tile ``raw``.

    Records that share a gzip member share its span.
    """
    view, at, n = memoryview(raw), 0, len(raw)
    found: tuple[list[dict], int] | None = None
    while at < n:
        try:
            records, after = found or _read_at(raw, view, at)
            for record in records:
                yield "record", at, after, record
            at, found = after, None
            continue
        except Damaged as e:
            reason = str(e)
        gap, search = at, at + 1
        while True:
            place = _NEXT.search(raw, search)
            if not place:
                at = n
                break
            try:
                found, at = _read_at(raw, view, place.start()), place.start()
                break
            except Damaged:
                search = place.start() + 1
        yield "gap", gap, at, reason


def _storage(uri: str):
    """The file system of a folder; Hadoop's names of stores are spelled as Arrow has them."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _writer(root: str, archive_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        storage, base = _storage(root)
        out, name, n, size = None, "", 0, 0

        def closed() -> pd.DataFrame:
            out.close()
            return pd.DataFrame({"archive": [name], "records": [n], "bytes": [size]}, dtype=object)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    storage.create_dir(base, recursive=True)
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = storage.open_output_stream(f"{base}/{name}", compression=None)
                refers_to = r.refers_to if isinstance(r.refers_to, str) else None
                payload = (r.html or "").encode("utf-8", "surrogatepass") if refers_to is None else b""
                digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                size += out.write(record_bytes(r.page_id if isinstance(r.page_id, str) else None, r.url, payload, digest, int(r.size), refers_to))
                n += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` under ``root``; gives the manifest ``(archive, records, bytes)``.

    The manifest must be kept (written) once: evaluating it writes the archives.  Ids
    may be of any type that has an order.  Urls of any length are written whole.  A
    null html is an empty payload.  Equal payloads shorter than ``min_payload`` bytes
    are each stored.  A null id is never referred to unless no equal record has one
    (all such are stored); repeated rows with the largest id are all stored.  No rows
    make no archive.  Other columns are not looked at.  ``root`` is a folder that Spark
    and Arrow both reach (a shared path, ``hdfs:``, ``s3a:``, ``gs:``).
    """
    ship(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    latest = own.groupBy("sha1", "size").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies"))
    # only payloads that occur more than once need the join; most do not
    shared = latest.where((F.col("copies") > 1) & (F.col("size") >= min_payload)).select(F.col("sha1").alias("s_"), F.col("size").alias("z_"), "latest")
    marked = own.join(shared, (F.col("sha1") == F.col("s_")) & (F.col("size") == F.col("z_")), "left")
    refers = F.when(F.col("latest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("latest"))), F.col("latest"))
    rows = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(refers.isNull(), F.col("html")).alias("html"), "sha1", "size", refers.cast("string").alias("refers_to"))
    # each task of the join writes its own archives: payloads are moved once
    return rows.mapInPandas(_writer(root, archive_bytes), "archive string, records long, bytes long")


RECORDS = "archive string, kind string, start long, end long, reason string, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, root: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of every archive under ``root``, or of those that ``manifest`` names.

    A row per record or gap; ``reason`` tells why a gap's bytes are quarantined.  Damaged
    and empty archives give what can be read of them, repeated records a row each; a
    folder without archives gives none.  ``payloads=False`` leaves payloads out.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(root).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if manifest is not None:
        files = files.join(manifest.select("archive"), "archive", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORDS.split(", ")]
        for pdf in batches:
            for archive, raw in zip(pdf["archive"], pdf["content"]):
                rows, held = [], 0
                for kind, a, b, found in salvage(bytes(raw)):
                    f = found if kind == "record" else {"reason": found}
                    if not payloads:
                        f.pop("payload", None)
                    rows.append({"archive": archive, "kind": kind, "start": a, "end": b, **f})
                    held += len(f.get("payload") or b"") + 1000
                    if held > 16 << 20:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.mapInPandas(run, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root = f"{scratch.root}/archives"
    manifest = scratch.keep(write_warc(table(spark, sf_dir, "pages"), root), "manifest")
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if not written:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    read = scratch.keep(read_warc(spark, root, manifest, payloads=False).drop("payload"), "read")
    gaps, found = read.agg(F.count_if(F.col("kind") == "gap"), F.count_if(F.col("kind") == "record")).first()
    if gaps or found != written:
        raise RuntimeError(f"of {written} records written, {found} were read back, with {gaps} gaps between")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
