"""WARC archives: an index first, then byte ranges.

Writing leaves archives of one gzip member per record and returns the index: one row per record with
file, offset, length, URL and digest. Reading takes index rows (all, or any selection), sorts them by
file and offset, and fetches neighbouring records with one read. Tasks write and read below the
shared folder through Arrow's file systems. A retried task writes files of its own, and only files
that the index names are ever read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import scratch, slices, stored

# Record header names and values of WARC 1.1.
_VERSION = "WARC/1.1"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

INDEX = ("page_id long, file string, offset long, length long, url string, digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload binary, "
          "payload_bytes long, payload_digest string, stored_bytes long")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _record(page: int | None, url: str | None, first: int | None, payload: bytes, digest: str) -> bytes:
    """One record; a revisit names the record it repeats and has no payload of its own."""
    revisit = first is not None
    lines = [
        _VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {_SAME_PAYLOAD}", f"WARC-Refers-To: <urn:page:{first}>"]
    body = b"" if revisit else payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(member: bytes) -> dict:
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if version != _VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a record at this offset")
    number = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    url = fields.get("WARC-Target-URI")
    kind, payload = fields["WARC-Type"], rest[:size]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = sha1_base32(payload)
        if found != digest:
            raise ValueError(f"payload digest {found}, header has {digest}")
    return {
        "page_id": number("WARC-Record-ID"), "record_type": kind, "refers_to": number("WARC-Refers-To"),
        "url": url and url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "payload": payload if kind == "response" else None, "payload_digest": digest,
        "payload_bytes": int(fields["X-Payload-Length"]), "stored_bytes": len(member),
    }


def _writer(folder: str, roll: int, level: int):
    kinds = [("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
             ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
             ("record_type", pa.string()), ("refers_to", pa.int64())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches, "html", 8 << 20):
                rows = []
                for page, url, first, html in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "first", "html"))):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (html or "").encode()
                    digest = sha1_base32(payload)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(_record(page, url, first, payload, digest)) + squeeze.flush()
                    out.write(member)
                    rows.append((page, f"{folder}/{name}", at, len(member), url, digest, len(payload),
                                 "response" if first is None else "revisit", first))
                    at += len(member)
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_bytes: int = 0, roll: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write one record per row, and return the stored index.

    The payload is the text in UTF-8; null is empty. Of equal payloads of at least `min_bytes`, the
    row with the smallest id is a response, and the others are revisits that refer to it; all smaller
    payloads are responses. A null id never leads a group unless all its ids are null (then all are
    responses); rows that repeat the leading id are responses too. `roll` is the size at which a task
    begins a new file.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.sha2(payload, 256).alias("same"), F.length(payload).alias("size"))
    # Written, so that the size of what repeats is known before it is joined.
    leaders = stored(
        rows.where(F.col("size") >= min_bytes).groupBy("same")
        .agg(F.min("page_id").alias("leader"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("leader").isNotNull()).select("same", "leader"), "warc-leaders")
    marked = rows.join(leaders, "same", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")).alias("first"))
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return stored(marked.mapInArrow(_writer(folder, roll, level), INDEX), "warc-index")


def _reader(gap: int, most: int):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("stored_bytes", pa.int64())]

    def fetch(store: fs.FileSystem, file, run: list[tuple[int, int]]) -> pa.RecordBatch:
        start, end = run[0][0], run[-1][0] + run[-1][1]
        file.seek(start)
        data = file.read(end - start)
        rows = [_parse(data[at - start:at - start + n]) for at, n in run]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, file, run = None, None, None, []
        for batch in batches:
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if run and (path != name or at > run[-1][0] + run[-1][1] + gap or at + n - run[0][0] > most):
                    yield fetch(store, file, run)
                    run = []
                if path != name:
                    if file is not None:
                        file.close()
                    store, inner = _open(path)
                    name, file = path, store.open_input_file(inner)
                run.append((at, n))
        if run:
            yield fetch(store, file, run)
        if file is not None:
            file.close()

    return read


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records that the index rows name, with payloads (null for revisits), digests checked.

    Records of a file whose distance is at most `gap` bytes come with one read of up to `most` bytes
    (one record, if that is longer). No rows give no records; a row that is asked for twice comes
    twice.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("file", "offset", "length")
    ordered = wanted.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_reader(gap, most), RECORD)
