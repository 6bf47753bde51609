"""WARC archives with an index first: write, select in the index, read byte ranges.

Each task writes its records, one gzip member each, into archives of its own in
the shared folder and hands out index rows (file, offset, length, URL, digest).
Spark commits the index rows of the task that succeeded; an archive of a lost
task is in no index row. Reading sorts the selected index rows by file and
offset and merges close ranges into one read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.runtime import materialize, new_scratch_path

#: Payloads of fewer bytes are always written in full.
REVISIT_FROM = 100
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Selected ranges this close are read together, up to as many bytes at once (a larger record is one read).
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
DATE = "2025-01-01T00:00:00Z"

INDEX = ["file", "offset", "length", "url", "digest"]


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _uri(page) -> str:
    return f"urn:uuid:{uuid.uuid4()}" if page is None else f"urn:page:{quote(str(page), safe='')}"


def record(page, url, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One response record, or a revisit record if `refers_to` names the page that holds the payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_uri(page)}>"),
              ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_uri(refers_to)}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, fields of its HTTP head, and the body that follows."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no record starts here")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


class _Archives:
    """Archives that one task writes, one after the other."""

    def __init__(self, folder: str, limit: int):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.limit, self.out = folder, limit, None

    def write(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.store.create_dir(self.path, recursive=True)
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(raw)
        place = f"{self.folder}/{self.name}", self.at, len(raw)
        self.at += len(raw)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row and return the index: id, file, offset, length, url, digest.

    `folder` must be one that all nodes reach. Of rows with equal payloads of
    `revisit_from` bytes or more, the one with the smallest id is the response
    and the others revisit it. A NULL body is an empty payload, a NULL URL is
    left out. A row without an id is written under a new name; it revisits, but
    is not revisited. Repeated rows are all written; those with the smallest id
    are all responses. Without rows the index is empty.
    """
    page = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"))
    page = page.withColumn("digest", F.sha2("body", 256))
    firsts = materialize(page.filter(F.octet_length("body") >= revisit_from).groupBy("digest")
                         .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # Spark splits a digest with many rows: only their side of the join is large.
    rows = page.join(firsts, "digest", "left").withColumn(
        "first", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches):
        archives = _Archives(folder, archive_bytes)
        try:
            for batch in batches:
                places = []
                for r in range(batch.num_rows):
                    digest, page, url, body, first = (batch.column(k)[r].as_py() for k in range(5))
                    places.append(archives.write(gzip_member(record(page, url, body.encode(), digest, first))))
                file, offset, length = zip(*places) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()),
                     batch.column(2), batch.column(0)], names=schema.names)
        finally:
            archives.close()

    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("url", T.StringType()),
                           T.StructField("digest", T.StringType())])
    return materialize(rows.select("digest", "page", "url", "body", "first").mapInArrow(write, schema))


def merged_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, start, end): runs of sorted (offset, length) ranges that one read covers."""
    lo = 0
    for k, (offset, length) in enumerate(ranges):
        if k and (offset - end > gap or offset + length - ranges[lo][0] > most):
            yield lo, k, ranges[lo][0], end
            lo = k
        end = offset + length if k == lo else max(end, offset + length)
    if ranges:
        yield lo, len(ranges), ranges[lo][0], end


def read_records(index: DataFrame, id_col: str = "page_id", bodies: bool = True) -> DataFrame:
    """The records of the index rows: id, url, record_type, refers_to, payload_bytes, payload_digest and, if asked for, payload.

    A response's size and digest are those of the payload read and must agree
    with the index, else the job fails. A revisit has no body of its own
    (payload NULL); its size and digest come from its headers.
    """
    rows = index.select(id_col, *INDEX)
    rows = rows.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        opened: tuple = (None, None)
        for batch in batches:
            files, offsets, lengths, digests = (batch.column(k).to_pylist() for k in (1, 2, 3, 5))
            lo = 0
            while lo < batch.num_rows:
                hi = lo
                while hi < batch.num_rows and files[hi] == files[lo]:
                    hi += 1
                if opened[0] != files[lo]:
                    if opened[1] is not None:
                        opened[1].close()
                    store, path = fs.FileSystem.from_uri(files[lo])
                    opened = files[lo], store.open_input_file(path)
                for a, b, start, end in merged_ranges(list(zip(offsets[lo:hi], lengths[lo:hi]))):
                    data = opened[1].read_at(end - start, start)
                    out = {name: [] for name in schema.names[2:]}
                    for k in range(lo + a, lo + b):
                        at = offsets[k] - start
                        fields, http, body = parse(zlib.decompress(data[at:at + lengths[k]], 31))
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest()
                        if digest != digests[k]:
                            raise ValueError(f"{files[k]} at {offsets[k]}: digest {digest}, index {digests[k]}")
                        refers = fields.get("WARC-Refers-To")
                        values = (fields["WARC-Type"], refers and unquote(refers[1:-1].removeprefix("urn:page:")),
                                  int(http["Content-Length"]) if revisit else len(body), digest, None if revisit else body.decode())
                        for name, value in zip(out, values):
                            out[name].append(value)
                    part = batch.slice(lo + a, b - a)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(4), *[pa.array(v, pa.int64() if n == "payload_bytes" else pa.string())
                                                           for n, v in out.items()]], names=schema.names)
                lo = hi
        if opened[1] is not None:
            opened[1].close()

    kind = index.schema[id_col].dataType
    text = [T.StructField(n, T.LongType() if n == "payload_bytes" else T.StringType())
            for n in ("record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * bodies)]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("url", T.StringType()), *text])
    return rows.mapInArrow(read, schema).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write all rows into a new folder under `spark.checkpoint.dir`, then read all of them back (without bodies)."""
    folder = new_scratch_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, body_col)
    return read_records(index, id_col, bodies=False)
