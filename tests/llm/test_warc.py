import base64
import gzip
import hashlib

import pytest

from pyspark.sql import functions as F

from tarnfall.llm import warc
from tarnfall.llm.shared import filesystem, saved, shared_dir

PAGES = "page_id long, url string, html string, record_type int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def check(pages):
    rows = pages.select("page_id", "html").collect()
    least = {}
    for r in rows:
        if r.page_id is not None:
            least[digest(r.html)] = min(least.get(digest(r.html), r.page_id), r.page_id)
    want = []
    for r in rows:
        d = digest(r.html)
        own = d not in least or least[d] == r.page_id
        want.append((r.page_id, len((r.html or "").encode()), d, "response" if own else "revisit", None if own else least[d]))
    key = lambda r: tuple(map(str, r))
    out = warc.archive_pages(pages).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {(r.page_id, digest(r.html)): r.html or "" for r in rows}
    assert all(r.payload == (texts[r.page_id, r.payload_digest] if r.record_type == "response" else None) for r in out)


def test_pages(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_odd_pages(spark):
    rows = [(1, "http://a/", "<p>é</p>", 0), (2, None, None, 0), (3, "http://c/\r\nx: y", "", 0), (4, "http://d/", "<p>é</p>", 0), (5, "u", "x\r\n\r\ny" * 40_000, 0), (6, "u", "x\r\n\r\ny" * 40_000, 0), (7, "http://a/", "<p>e</p>", 0)]
    check(spark.createDataFrame([*rows, rows[4], (None, None, "a page without an id", 0)], PAGES))
    check(spark.createDataFrame([], PAGES))
    one = spark.createDataFrame([(None, "u", "x", 0), (9, "u", "x", 0), (9, "u", "x", 0)], PAGES)
    assert [(r.page_id, r.refers_to) for r in warc.archive_pages(one).orderBy("page_id").collect()] == [(None, 9), (9, None), (9, None)]


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "same", 0), (2, "u", "same", 0)], PAGES)
    assert {r.record_type for r in warc.archive_pages(pages, min_bytes=5).collect()} == {"response"}
    assert {r.record_type for r in warc.archive_pages(pages, min_bytes=4).collect()} == {"response", "revisit"}


def test_index_selects_ranges(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = saved(warc.write_archives(warc.mark_revisits(pages), shared_dir(spark, "warc")), "index")
    some = index.where("page_id % 7 = 3")
    for gap, most in ((0, 1), (64 << 10, 8 << 20)):
        got = {r.page_id: r.url for r in warc.read_records(some, gap, most).collect()}
        assert got == {r.page_id: r.url for r in pages.where("page_id % 7 = 3").collect()}
    name = index.select("archive").first().archive
    fs, path = filesystem(name)
    with fs.open_input_file(path) as f:
        whole = gzip.decompress(f.read())  # members one after another are one gzip file
    assert whole.count(b"WARC/1.1\r\n") == index.where(index.archive == name).count()


def test_damage_is_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "payload", 0)], PAGES)
    index = saved(warc.write_archives(warc.mark_revisits(pages), shared_dir(spark, "warc")), "index")
    with pytest.raises(Exception):  # noqa: B017
        warc.read_records(index.withColumn("offset", F.col("offset") + 3)).collect()
