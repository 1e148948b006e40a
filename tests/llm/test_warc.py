from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from regionflow.llm import warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://b.example.org/x?q=1", "<p>one</p>"), (2, "http://a.example.org:8080/", "<p>one</p>"), (3, "https://a.example.org/", None), (4, None, ""), (5, "not an url", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "http://a.example.org/\tz", "x" * 300_000), (7, "http://b.example.org/x?q=1", "two"), (7, "http://b.example.org/x?q=1", "two"), (None, "http://c.org/", "<p>one</p>"), (-4, "http://[bad", "two"),
]


def expected(rows, least=0):
    newest = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= least:
            newest[h] = max(i, newest.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = newest.get(h or "")
        again = to is not None and to != i
        out.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(to) if again else "None"))
    return sorted(out)


def read(df, folder, tops):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in warc.look_up(df, folder, tops).collect())


@pytest.fixture
def pages(spark):
    many = [(100 + i, f"http://h{i % 7}.example.com/p{i}", f"<p>{i % 400}</p>") for i in range(1500)]
    return spark.createDataFrame(ROWS + many, SCHEMA).repartition(4), ROWS + many


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, least, monkeypatch):
    df, rows = pages
    assert read(df, *warc.archive(df, least=least)) == expected(rows, least)


def test_blocks_and_directories(pages):
    df, rows = pages
    folder, tops = warc.archive(df)
    reader = warc.Reader(folder, tops)
    assert [t[0] for t in tops] == sorted(t[0] for t in tops)
    keys = [line[0] for part in range(len(tops)) for n in range(len(reader.directory(part)[0])) for line in ([x.split(b"\t") for x in reader.block(part, n)[0]])]
    assert len(keys) == len(rows)
    for part in range(len(tops)):
        firsts = reader.directory(part)[1]
        assert firsts == sorted(firsts)
        for n in range(len(firsts)):
            assert reader.block(part, n)[1] == sorted(reader.block(part, n)[1]) and reader.block(part, n)[1][0] == firsts[n]
    assert [c["capture"] for c in reader.captures("http://b.example.org/x?q=1")] == [1, 7, 7]
    assert list(reader.captures("http://nowhere.org/")) == []


def test_archives_are_plain_warc(pages):
    df, rows = pages
    folder, _ = warc.archive(df.filter("page_id < 10"))
    files, root = pafs.FileSystem.from_uri(folder)
    text = b"".join(gzip.decompress(files.open_input_file(f.path).read()) for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".warc.gz"))
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Type: ") == sum(i is not None and i < 10 for i, *_ in rows)


def test_url_keys():
    assert warc.url_key("http://www.Example.org/a?b=c") == "org,example,www)/a?b=c"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no%20url"


def test_empty_and_clashing(spark, pages):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.look_up(none, *warc.archive(none)).count() == 0
    from pyspark.sql import functions as F

    df = pages[0].withColumns({n: F.lit(1) for n in ("capture", "digest", "body", "key", "file", "start", "size", "of")})
    assert warc.look_up(df, *warc.archive(df)).count() == df.count()
