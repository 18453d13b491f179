import gzip
import hashlib
import os
import re

import pytest
from conftest_llm import with_clashes

from pyspark.sql import functions as F

from clustercat.llm import warc

PAGES = "page_id long, url string, html string"


def odd_pages(spark):
    long = "<p>é</p>" * 100_000
    rows = [
        (1, "http://a.example/x", "y" * 150), (2, "http://a.example/y", "y" * 150), (2, "http://a.example/y", "y" * 150),
        (3, None, "y" * 99), (4, "bad\r\nX: 1", "y" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long),
        (None, "u", "z" * 200), (None, None, "z" * 200), (9, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20), (10, "u", "\n" * 200),
    ]
    return with_clashes(spark.createDataFrame(rows, PAGES))


def test_odd_rows_in_small_chunks(shipped):
    chunks = warc.archive_pages(shipped, odd_pages(shipped), chunk=1000)
    rows = chunks.collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 1000
        data = whole.setdefault(r["record_id"], bytearray())
        data += r["data"]
        assert r["bytes_so_far"] == len(data) and r["sha256_so_far"] == hashlib.sha256(data).hexdigest()
    found = warc.page_records(chunks).collect()
    pages = odd_pages(shipped).collect()
    expected = sorted((str(r["page_id"]), hashlib.sha256((r["html"] or "").encode()).hexdigest(), len((r["html"] or "").encode())) for r in pages)
    assert sorted((str(r["page_id"]), r["payload_digest"], r["payload_bytes"]) for r in found) == expected
    kinds = {}
    for r in found:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert kinds["1"] == [("response", None)] and kinds["2"] == [("revisit", "1")] * 2
    assert kinds["8"] == [("revisit", "7")] and kinds["3"] == kinds["4"] == [("response", None)]
    assert sorted(k for k, _ in kinds[None]) == ["response", "revisit"]
    assert warc.archive_pages(shipped, odd_pages(shipped).filter("page_id = 99")).count() == 0


def test_archives_are_warc(shipped, tmp_path):
    pages = odd_pages(shipped)
    from clustercat.llm.common import located
    from clustercat.storage import keep

    pages = keep(pages)
    decided = keep(warc.decide_records(pages, "page_id", "html", "url", 100))
    archives = warc.write_archives(warc.record_chunks(pages, decided, "html"), f"file://{tmp_path}/w", archive_bytes=1)
    listed = archives.collect()
    assert sum(r["records"] for r in listed) == 13 and all(r["records"] == 1 for r in listed)
    for r in listed:
        data = gzip.open(os.path.join(tmp_path, "w", r["path"])).read()
        head, _, body = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(body) == int(fields[b"Content-Length"]) + 4
        assert re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields[b"WARC-Date"]) and fields[b"WARC-Target-URI"]
        if fields[b"WARC-Type"] == b"response":
            payload = body.partition(b"\r\n\r\n")[2][:-4]
            assert fields[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
        assert body.startswith(b"HTTP/1.1 200 OK\r\n") and body.endswith(b"\r\n\r\n")
    # An archive that no task reported is not read.
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"half a file")
    assert warc.read_archives(archives, f"file://{tmp_path}/w").filter("last").count() == 13
    assert located(pages).count() == 13


def test_damage_is_found(shipped, tmp_path):
    from clustercat.llm.common import filed

    pages = filed(odd_pages(shipped).filter("page_id = 1"))
    decided = warc.decide_records(pages, "page_id", "html", "url", 100)
    chunks = warc.record_chunks(pages, decided, "html", date="2020-01-01T00:00:00Z")
    archives = warc.write_archives(chunks, f"file://{tmp_path}/w")
    (listed,) = archives.collect()
    path = tmp_path / "w" / listed["path"]
    data = gzip.decompress(path.read_bytes())
    assert b"WARC-Date: 2020-01-01T00:00:00Z\r\n" in data
    path.write_bytes(gzip.compress(data.replace(b"yyyy", b"yxyy", 1)))
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_archives(archives, f"file://{tmp_path}/w").count()
    # Chunks that are missing, or are not what was digested, are not written.
    short = warc.record_chunks(pages, decided, "html", chunk=60).filter("not last")
    with pytest.raises(Exception, match="end early"):
        warc.write_archives(short, f"file://{tmp_path}/x")
    other = warc.record_chunks(pages, decided, "html").selectExpr(
        "record_id", "chunk_no", "if(chunk_no < 0, data, reverse(concat('x', data))) as data", "bytes_so_far", "sha256_so_far", "last"
    ).withColumn("data", F.col("data").cast("binary"))
    with pytest.raises(Exception, match="not what was digested"):
        warc.write_archives(other, f"file://{tmp_path}/x")


def test_archives_are_read_by_many_tasks(shipped, tmp_path):
    from clustercat.llm.common import filed

    pages = filed(odd_pages(shipped))
    chunks = warc.record_chunks(pages, warc.decide_records(pages, "page_id", "html", "url", 100), "html")
    archives = warc.write_archives(chunks, f"file://{tmp_path}/w", archive_bytes=1)
    read = warc.read_archives(archives, f"file://{tmp_path}/w").withColumn("task", F.spark_partition_id())
    assert read.filter("last").select("task").distinct().count() > 6
