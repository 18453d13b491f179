"""Web archives as a table of chunks, written and read without holding a whole record.

A record travels as rows of its identifier and chunk number: its headers, then its payload in
chunks of bounded size, cut at the scan, each carrying the digest of the payload so far. Chunks are
shuffled and sorted by identifier and number; writers append them to a compressed member per record as
they come, and readers give chunks out as the archive is inflated. Both compare the digests.
Archives lie in the cluster's shared folder. A task's archive counts only if the task
has reported it, so what a lost executor leaves behind is never read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clustercat.llm.common import filed, located, small_batches
from clustercat.storage import keep, new_path

CHUNK = 256 << 10
BATCH_BYTES = 8 << 20
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "record_id string, record_type string, page_id string, refers_to string, chunk_no int, data binary, "
    "bytes_so_far long, sha256_so_far string, last boolean"
)


def payload_chunks(rows: DataFrame, chunk: int = CHUNK, ends_only: bool = False) -> DataFrame:
    """``rows``, whose ``payload`` is binary, as rows ``chunk_no, data, last, bytes_so_far, sha256_so_far``.

    The payload is cut where it is scanned and its digest goes on from chunk to chunk, so no
    later step meets more than a chunk of it. An empty payload is one empty chunk. With
    ``ends_only`` only each row's last chunk comes back, without its data.
    """
    count = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    others = [c for c in rows.columns if c != "payload"]
    cut = cut.select(*others, "chunk_no", part.alias("data"), (F.col("chunk_no") == count - 1).alias("last"))
    gone = ["data", "last", "chunk_no"] if ends_only else []

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far, size, expected = hashlib.sha256(), 0, 0
        for batch in batches:
            sums, sizes = [], []
            for number, data, last in zip(*(batch.column(c) for c in ("chunk_no", "data", "last"))):
                if number.as_py() != expected:
                    raise ValueError("the chunks of a row do not follow one another")
                if not expected:
                    so_far, size = hashlib.sha256(), 0
                data = data.as_buffer()
                so_far.update(data)
                size += len(data)
                sums.append(so_far.hexdigest())
                sizes.append(size)
                expected = 0 if last.as_py() else expected + 1
            kept = [c for c in batch.schema.names if c not in gone]
            columns = [*(batch.column(c) for c in kept), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())]
            out = pa.RecordBatch.from_arrays(columns, [*kept, "bytes_so_far", "sha256_so_far"])
            yield out.filter(batch.column("last")) if ends_only else out

    fields = [StructField(f.name, f.dataType) for f in cut.schema.fields if f.name not in gone]
    return cut.mapInArrow(
        digest, StructType([*fields, StructField("bytes_so_far", LongType()), StructField("sha256_so_far", StringType())])
    )


def decide_records(
    pages: DataFrame, id_column: str, payload_column: str, url_column: str, least_bytes: int, chunk: int = CHUNK
) -> DataFrame:
    """Each page's digest, size and type; ``first`` is the row that a revisit refers to. No payloads."""
    payload = F.coalesce(F.col(payload_column), F.lit("")).cast("binary")
    named = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), payload.alias("payload"))
    rows = payload_chunks(located(named), chunk, ends_only=True)
    rows = keep(rows.withColumnsRenamed({"bytes_so_far": "bytes", "sha256_so_far": "digest"}), "page-digests")
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "_cc_file", "_cc_row")
    repeated = (
        rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    ).filter("n > 1").drop("n")
    joined = rows.join(repeated, "digest", "left")
    is_first = (F.col("first._cc_file") == F.col("_cc_file")) & (F.col("first._cc_row") == F.col("_cc_row"))
    return joined.withColumn("revisit", F.col("first").isNotNull() & ~F.coalesce(is_first, F.lit(False)))


def record_chunks(
    pages: DataFrame, decided: DataFrame, payload_column: str, chunk: int = CHUNK, date: str | None = None
) -> DataFrame:
    """Rows ``record_id, chunk_no, data, bytes_so_far, sha256_so_far, last``; a record's rows follow one another.

    Chunk -1 is the record's headers, with the size and digest its payload must come to (a
    revisit has neither, and its payload is not written). ``date`` is the ``WARC-Date`` of
    all records, the time of the call by default.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    name = lambda file, row: F.concat(F.lit("urn:x-row:"), F.lower(F.hex(file)), F.lit(":"), row)
    own = name(F.col("_cc_file"), F.col("_cc_row"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    target = F.when(F.length(target) > 0, target).otherwise(own)
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(key + ": "), value, F.lit("\r\n"))).otherwise("")
    length = F.lit(len(HTTP)) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Page-ID", F.col("id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        line(
            "WARC-Refers-To",
            F.when(F.col("revisit"), F.concat(F.lit("<"), name(F.col("first._cc_file"), F.col("first._cc_row")), F.lit(">"))),
        ),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n" + HTTP),
    )
    written = ~F.col("revisit")
    heads = decided.select(
        "_cc_file", "_cc_row", F.lit(-1).alias("chunk_no"), head.cast("binary").alias("data"), F.lit(False).alias("last"),
        F.when(written, F.col("bytes")).alias("bytes_so_far"), F.when(written, F.col("digest")).alias("sha256_so_far"),
    )
    source = located(pages.select(F.coalesce(F.col(payload_column), F.lit("")).cast("binary").alias("payload")))
    rows = heads.unionByName(payload_chunks(source, chunk))
    rows = rows.repartition("_cc_file", "_cc_row").sortWithinPartitions("_cc_file", "_cc_row", "chunk_no")
    return rows.select(own.alias("record_id"), "chunk_no", "data", "bytes_so_far", "sha256_so_far", "last")


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write chunk rows to compressed archives below ``folder``; returns ``path, records`` of those that count.

    A record is a compressed member. Its digest is taken as its chunks pass; rows that belong to
    another record, come out of turn or do not come to what the headers say end the task with an error.
    """
    names = ("record_id", "chunk_no", "data", "bytes_so_far", "sha256_so_far", "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, records, size = None, "", 0, 0
        member = record = due = so_far = None
        expected, taken, whole = 0, 0, True

        def report():
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        def close_member():
            if not whole:
                raise ValueError(f"the chunks of {record} end early")
            return out.write(member.compress(END) + member.flush())

        for batch in batches:
            for key, number, data, total, digest, last in zip(*(batch.column(c) for c in names)):
                key, number, data, digest = key.as_py(), number.as_py(), data.as_buffer(), digest.as_py()
                if number < 0:
                    if member is not None:
                        size += close_member()
                        if size >= archive_bytes:
                            out.close()
                            yield report()
                            out = None
                    if out is None:
                        path = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, records, size = system.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    records += 1
                    record, due, so_far, expected, taken = key, (total.as_py(), digest), hashlib.sha256(), 0, 0
                    whole = digest is None
                    size += out.write(member.compress(data))
                    continue
                if key != record or number != expected:
                    raise ValueError(f"chunk {number} of {key} comes out of turn")
                expected += 1
                if due[1] is None:
                    continue  # a revisit's payload is in the record that it refers to
                so_far.update(data)
                taken += len(data)
                size += out.write(member.compress(data))
                whole = last.as_py()
                if so_far.hexdigest() != digest or (whole and (taken, digest) != due):
                    raise ValueError(f"chunk {number} of {key} is not what was digested")
        if out is not None:
            close_member()
            out.close()
            yield report()

    return keep(chunks.select(*names).mapInArrow(write, "path string, records long"), "archives")


def _headers(stream: io.BufferedReader) -> tuple[bytes, dict[str, str]]:
    first, found = stream.readline(), {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode().rstrip("\r\n").partition(": ")
        found[key.lower()] = value
    return first, found


def _records(stream: io.BufferedReader, chunk: int) -> Iterator[tuple]:
    """Chunk rows of an inflated archive; every record gives at least one, with ``last`` set on its final one."""
    while stream.peek(1):
        first, head = _headers(stream)
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        left = int(head["content-length"])
        while left > 0:  # the HTTP headers, which the payload does not include
            line = stream.readline(left)
            left -= len(line)
            if line in (b"\r\n", b""):
                break
        named = head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-page-id")
        refers, stated = head.get("warc-refers-to"), head.get("warc-payload-digest")
        digest, size, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            size += len(data)
            digest.update(data)
            if not left and named[1] == "response" and stated and stated != f"sha256:{digest.hexdigest()}":
                raise ValueError(f"the payload of {named[0]} is not what its digest says")
            yield (*named, refers and refers.strip("<>"), number, data, size, digest.hexdigest(), left == 0)
            number += 1
            if not left:
                break
        if stream.read(len(END)) != END:
            raise ValueError("a record is not closed as it should be")


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that ``archives`` lists by ``path``, about an archive a task.

    A response whose payload does not come to the digest in its headers is an error.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        rows, size = [], 0

        def flush():
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                raw = system.open_input_stream(f"{root}/{path}", compression=None)
                with raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in _records(stream, chunk):
                        rows.append(row)
                        size += len(row[5]) + 300
                        if size >= BATCH_BYTES:
                            yield flush()
                            rows, size = [], 0
        yield flush()

    # The list is small however large the archives are, so the number of tasks is given.
    dealt = archives.select("path").repartitionByRange(max(archives.count(), 1), "path")
    return dealt.mapInArrow(read, CHUNK_SCHEMA)


def archive_pages(
    spark: SparkSession,
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 100,
    chunk: int = CHUNK,
) -> DataFrame:
    """Write one record per row of ``pages`` and return the chunk table read back.

    Of rows with equal payloads of at least ``least_bytes``, that with the smallest id
    (null ids last, then by place in the files) is a response and the others are
    revisits without payload; all smaller payloads are responses. Null and empty payloads are
    responses with one empty chunk. A null id leaves its header out, a null or
    empty url becomes the record's own name; control characters and blanks in a url become ``%20``. Repeated rows are records of
    their own; an empty table gives no archive and no rows; other columns are ignored.
    """
    small_batches(pages)
    pages = filed(pages)
    folder = new_path(spark, "warc")
    folder = folder if ":" in folder else f"file://{folder}"
    decided = keep(decide_records(pages, id_column, payload_column, url_column, least_bytes, chunk), "records")
    archives = write_archives(record_chunks(pages, decided, payload_column, chunk), folder)
    return read_archives(archives, folder, chunk)


def page_records(chunks: DataFrame) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``, revisits resolved by what they refer to."""
    ends = keep(chunks.filter("last").drop("data"), "record-ends")
    whole = ends.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"),
        F.col("bytes_so_far").alias("to_bytes"), F.col("sha256_so_far").alias("to_digest"),
    )
    revisit = F.col("record_type") == "revisit"
    return ends.join(whole, "refers_to", "left").select(
        "page_id",
        F.when(revisit, F.col("to_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("to_digest")).otherwise(F.col("sha256_so_far")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("to_page")).alias("refers_to"),
    )
