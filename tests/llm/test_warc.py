import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import same
from virocohort.llm import warc

ROWS = [(5, "http://a.com/x", "<p>one</p>"), (2, "http://b.a.com/", "<p>one</p>"), (9, "https://a.com/y", ""), (7, None, None), (8, "http://c.org/ a\r\nX: y", "<p>é\r\n\r\nz</p>" * 5000),
        (2, "http://b.a.com/", "<p>one</p>"), (None, "http://a.com/x", "<p>one</p>"), (11, "no scheme", "WARC/1.1\r\n\r\n"), (12, "http://A.com/x", "<p>two</p>")]


def brute(rows, least):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out, seen = [], set()
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((x for x in groups[html or ""] if x is not None), default=None)
        response = i is None or len(data) < least or (i == first and (html, i) not in seen)
        seen.add((html, i))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return out


@pytest.mark.parametrize("least", [0, 11])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "first", "size", "key", "file")})
    captures = warc.write_archives(pages, f"{tmp_path}/a", revisit_bytes=least, archive_bytes=2000)
    directory = warc.write_index(captures, f"{tmp_path}/i", block_lines=2)
    got = warc.read_archives(directory, f"{tmp_path}/i", f"{tmp_path}/a").collect()
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], brute(ROWS, least))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id == 8} == {8: ROWS[4][2].encode()}
    assert not list(Path(tmp_path).rglob("*.part"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (Path(tmp_path) / "a").iterdir())
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def test_lookup_by_block(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 40}", f"page {i}") for i in range(200)]
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/a")
    directory = warc.write_index(captures, f"{tmp_path}/i", block_lines=3)
    assert directory.agg(F.sum("lines")).first()[0] == 200 and directory.count() >= 66
    find = warc.Lookup.open(directory, f"{tmp_path}/i", f"{tmp_path}/a")
    for url in {u for _, u, _ in rows}:
        assert sorted(r[0] for r in find.records(url)) == sorted(i for i, u, _ in rows if u == url)
    assert find.records("http://h1.example.com/none") == [] and find.records("http://a.a/") == []


def test_keys_put_a_site_together():
    assert warc.url_key("http://WWW.Example.com/a?b") == "com,example,www)/a?b"
    assert warc.url_key(None) == warc.url_key("x") == ""


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w").collect() == []
