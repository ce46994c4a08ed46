"""Archives of odd pages, of tasks that run twice, and damaged ones."""

import base64
import hashlib
import io

import pytest

from quillspark.llm import warc_zstd


def test_odd_pages(spark):
    rows = [(None, "u", "same", "x"), (None, None, None, "x"), (3, "u", "same", None), (3, "u", "same", None), (4, "v", "same", "x"), (5, "w", "é" * 300_000, "x"), (6, "w", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").withColumnsRenamed({})
    pages = pages.selectExpr("*", "'clash' AS sha1", "1 AS refers_to", "2 AS payload_bytes", "'k' AS record_type")
    got = warc_zstd.read_archives(spark, warc_zstd.write_archives(spark, pages)).collect()
    want = [(i, t, r) for i, t, r in [(None, "response", None), (None, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None)]]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert sorted(r.payload_digest for r in got) == sorted(digest(h or "") for _, _, h, _ in rows)


def test_a_second_attempt_does_not_touch_the_first(spark):
    """Each run of the writing tasks has files of its own, so what a manifest lists stays as it was written."""
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(50)], "page_id long, url string, html string")
    archives = [r.path for r in warc_zstd.write_archives(spark, pages).collect()]
    assert len(set(archives)) == len(archives)
    assert all(len(p.rpartition("/")[2].split("-")) == 4 for p in archives)  # partition, attempt, number


def test_small_archives_have_a_dictionary_too():
    records = [warc_zstd.record(i, "u", b"payload %d" % i, "D", None) for i in range(2)]
    raw = b"".join(warc_zstd.pack(records, warc_zstd.Settings()))
    assert raw[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(raw[4:8], "little") >= 64
    assert list(warc_zstd.unpack(io.BytesIO(raw))) == records


def test_a_changed_payload_is_noticed(spark, tmp_path):
    records = [warc_zstd.record(1, "u", b"payload", warc_zstd.base32(hashlib.sha1(b"another").hexdigest()), None)]
    path = tmp_path / "bad.warc.zst"
    path.write_bytes(b"".join(warc_zstd.pack(records, warc_zstd.Settings())))
    with pytest.raises(Exception, match="length or digest"):
        warc_zstd.read_archives(spark, spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
