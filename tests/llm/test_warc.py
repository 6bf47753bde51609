import hashlib
import zlib

from pyarrow import fs
from pyspark.sql import types as T

from segspark.llm import warc
from segspark.runtime import new_scratch_path
from tests.llm.helpers import rows_of

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("first", T.StringType())])
BIG = "<p>größer</p>\r\n\r\nWARC/1.1\r\n" * 20
ROWS = [(5, "http://a/ b?c=ü\n", BIG), (2, "http://b/", BIG), (9, None, BIG), (None, "http://n/", BIG), (2, "http://b/", BIG),
        (7, "http://c/", "short"), (8, "http://d/", "short"), (10, "http://e/", ""), (11, "http://f/", None), (12, "http://g/", "x" * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_round_trip(spark):
    folder = new_scratch_path(spark, "warc-test")
    index = warc.write_archives(pages(spark, ROWS), folder, archive_bytes=200)
    assert index.columns == ["page_id", "file", "offset", "length", "url", "digest"] and index.count() == len(ROWS)
    got = rows_of(warc.read_records(index))
    assert len(got) == len(ROWS)
    for r in got:
        body = next(b or "" for p, _, b in ROWS if p == r["page_id"])
        assert r["payload_bytes"] == len(body.encode()) and r["payload_digest"] == hashlib.sha256(body.encode()).hexdigest()
        repeat = body == BIG and r["page_id"] != 2
        assert r["record_type"] == ("revisit" if repeat else "response") and r["refers_to"] == (2 if repeat else None)
        assert r["payload"] == (None if repeat else body)


def test_index_points_at_gzip_members_of_valid_records(spark):
    for r in rows_of(warc.write_archives(pages(spark, ROWS), new_scratch_path(spark, "warc-test"))):
        store, path = fs.FileSystem.from_uri(r["file"])
        with store.open_input_file(path) as f:
            raw = zlib.decompress(f.read_at(r["length"], r["offset"]), 31)
        fields, http, body = warc.parse(raw)
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.endswith(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha256:" + r["digest"] and int(fields["Content-Length"]) > 0
        assert "\n" not in fields.get("WARC-Target-URI", "")


def test_selected_records_only(spark):
    index = warc.write_archives(pages(spark, ROWS), new_scratch_path(spark, "warc-test"))
    assert {r["page_id"] for r in rows_of(warc.read_records(index.filter("page_id in (7, 12)")))} == {7, 12}


def test_empty_table(spark):
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_ranges_merge_up_to_the_gap_and_size():
    ranges = [(0, 10), (10, 5), (30, 5), (100, 50), (150, 200)]
    assert list(warc.merged_ranges(ranges, gap=20, most=160)) == [(0, 3, 0, 35), (3, 4, 100, 150), (4, 5, 150, 350)]
    assert list(warc.merged_ranges([], 1, 1)) == []
