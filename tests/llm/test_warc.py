"""Bundles: exact round trip, seek table, index, revisits."""

import io
import os

import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs

from longform.llm.common import shared_path
from longform.llm.warc import digest, read_record, read_records, read_seek_table, write_bundles, write_record

SCHEMA = "page_id bigint, url string, html string, k string, n string, refers_to string, revisit string"
ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "same"), (9, "http://a/9", "same"),
        (3, None, None), (4, "u\r\nX-Page-Id: 7", ""), (5, "http://a/5", "\r\n\r\nWARC/1.1\r\n\r\n" * 3), (None, "x", "only"),
        (None, "x", "same"), (6, "http://a/6", "z" * 3_000_000), (7, "ü 100%0A", "é ß")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def test_round_trip(spark):
    folder = shared_path(spark, "t")
    index = write_bundles(frame(spark), folder, frame_bytes=64)
    assert index.count() == len(ROWS)
    got = read_records(spark, folder).collect()
    assert sorted((r["page_id"] or -1, r["url"] or "", r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (i or -1, u or "", len((h or "").encode()), digest((h or "").encode())) for i, u, h in ROWS)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or 0) for r in got)
    assert kinds == sorted([(1, "revisit", 9), (2, "revisit", 9), (9, "response", 0), (9, "response", 0), (-1, "revisit", 9),
                            (3, "revisit", 4), (4, "response", 0), (5, "response", 0), (-1, "response", 0),
                            (6, "response", 0), (7, "response", 0)])
    payloads = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert all(payloads[i] == (h or "").encode() for i, _, h in ROWS if i in payloads)


def test_single_records_and_frames(spark):
    folder = shared_path(spark, "t")
    index = write_bundles(frame(spark), folder, frame_bytes=200)
    one = read_records(spark, folder, index.where("page_id = 5")).collect()
    assert len(one) == 1 and one[0]["payload"] == ROWS[6][2].encode()
    files, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    frames = 0
    for info in files.get_file_info(fs.FileSelector(f"{path}/bundles")):
        assert info.base_name.endswith(".warc.zst")
        with files.open_input_file(info.path) as f:
            table = read_seek_table(f)
            frames += len(table)
            f.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
            assert len(whole) == sum(r for _, _, r in table)
    assert frames == index.select("bundle", "frame").distinct().count() > 3


def test_short_payloads_stay_responses(spark):
    folder = shared_path(spark, "t")
    write_bundles(frame(spark), folder, min_revisit_bytes=5)
    assert {r["record_type"] for r in read_records(spark, folder).collect()} == {"response"}


def test_damage_is_seen():
    _, raw = write_record(1, "u", b"payload", None, False)
    assert read_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        read_record(raw.replace(b"payload\r\n", b"pAyload\r\n"))


def test_empty(spark):
    folder = shared_path(spark, "t")
    assert write_bundles(frame(spark).limit(0), folder).count() == 0
    assert read_records(spark, folder).count() == 0
    assert os.sep and pa
