"""WARC archives: writing, normalising and reading.

* ``write_archives`` writes records as monolithic gzip files: one gzip stream a file,
  which can only be read from its start.
* ``normalise`` inflates each such stream once, writes every record again as a gzip
  member of its own, and writes a sidecar index with the offset and length of each
  member, so a reader can seek to one record.
* ``read_records`` reads archives of either kind.

All files go through Spark's own readers and writers, so they may lie in any store
that Spark knows, and a lost task is simply run again. Inflating is streamed by
the reader's codec; a task holds one record at a time.
"""
from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators.joins import checked_small, left_lookup

CRLF = "\r\n"
#: Payloads of at least so many bytes may be stored once and revisited. Fixed value of the query.
MIN_SHARED = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def plan_revisits(pages: DataFrame, smallest: int = MIN_SHARED) -> DataFrame:
    """``pages`` (``page_id, url, html``) with payload, digest and the page each one revisits.

    Of pages with equal payloads of ``smallest`` bytes or more, that with the largest
    page_id keeps its payload; the others refer to it. The owner of a digest is a ``max`` with
    map-side combine. Digests that occur twice are stored and measured; a small table of them is
    broadcast, so payloads stay where they are. A larger one is joined by a shuffle that moves the
    payloads too; adaptive execution splits a digest of many rows, and pages below ``smallest``, which have
    no key, are spread over all tasks. Null html: empty payload. Pages without an id stay responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
    owners = p.where(F.col("payload_bytes") >= smallest).groupBy(F.col("payload_digest").alias("digest")).agg(
        F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    owners, small = checked_small(owners)
    shared = F.when(F.col("payload_bytes") >= smallest, F.col("payload_digest"))
    return left_lookup(p, [shared], owners, ["digest"], small).withColumn(
        "refers_to", F.when(F.col("owner") != F.col("page_id"), F.col("owner"))).drop("owner")


def record_text(planned: DataFrame) -> Column:
    """The bytes of one record, as text, without the two line ends that close it."""
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("html"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))

    def maybe(name: str, value: Column) -> Column:
        return F.coalesce(line(name, value), F.lit(""))

    clean = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        maybe("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">"))),
        maybe("WARC-Target-URI", clean), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line(
            "WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def write_archives(planned: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write the planned records as monolithic gzip files of at most ``records_per_file`` records."""
    planned.select(record_text(planned).alias("value")).write.option("compression", "gzip").option(
        "lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Parse one file's lines (without their ``\\n``) into (headers, head bytes, block) in order.

    The block ends where Content-Length says; lines of the block that look like a
    record's start are therefore never mistaken for one.
    """
    for line in lines:
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no record starts with {line[:40]!r}")
            continue
        head = [line + b"\n"]
        for line in lines:
            head.append(line + b"\n")
            if line.strip() == b"":
                break
        raw = b"".join(head)
        headers = {k.decode().strip().lower(): v.decode("utf-8", "replace") for k, v in _HEAD.findall(raw)}
        need = int(headers["content-length"])
        parts, have = [], 0
        # the block and the two line ends that close the record
        while have < need + 4:
            line = next(lines, None)
            if line is None:
                raise ValueError(f"a record ends after {have} of {need} bytes")
            parts.append(line + b"\n")
            have += len(line) + 1
        block = b"".join(parts)
        if block[need:] != b"\r\n\r\n":
            raise ValueError("a record isn't closed by two line ends")
        yield headers, raw, block[:need]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Group the rows (path, line) of a task by file. Rows of a file come together and in order."""
    rows = ((p, v) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    ahead = next(rows, None)

    def lines(path: str) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == path:
            value = ahead[1]
            ahead = next(rows, None)
            yield value

    while ahead is not None:
        path = ahead[0]
        yield path, lines(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line) of gzip archives; a gzip file is not splittable, so one task streams it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))


def member(record: bytes, level: int = 6) -> bytes:
    """``record`` as one gzip member whose last byte is zero.

    The last byte is the top byte of the member's length field, which is zero below 16 MB;
    after a longer record an empty member follows, which ends in zero.
    """
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    data = c.compress(record) + c.flush()
    if data[-1]:
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        data += c.compress(b"") + c.flush()
    return data


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the monolithic archives below ``source`` and return the sidecar index.

    ``target/kind=record/*.warc.gz`` hold one gzip member a record; the index, beside
    them in ``target/kind=index``, has ``part, seq, offset, length, record_id, headers``
    of every member, where ``part`` is the number in the archive's name. Data and index leave
    one task in one pass and are committed together, so they always agree. An empty
    source gives an empty index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset, seq = TaskContext.get().partitionId(), 0, 0
        for _, lines in _files(batches):
            kinds, seqs, values, size = [], [], [], 0
            for headers, head, block in _records(lines):
                data = member(head + block + b"\r\n\r\n")
                entry = json.dumps({"part": part, "seq": seq, "offset": offset, "length": len(data),
                                    "record_id": headers.get("warc-record-id"), "headers": headers},
                                   ensure_ascii=False)
                kinds += ["index", "record"]
                seqs += [seq, seq]
                # the writer puts back the zero byte as its separator
                values += [entry.encode("utf-8", "replace"), data[:-1]]
                offset += len(data)
                seq += 1
                size += len(data) + len(entry)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(seqs, pa.int64()), pa.array(
                        values, pa.binary())], names=["kind", "seq", "value"])
                    kinds, seqs, values, size = [], [], [], 0
            if kinds:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(seqs, pa.int64()), pa.array(
                    values, pa.binary())], names=["kind", "seq", "value"])

    out = _lines(spark, source).mapInArrow(run, "kind string, seq long, value binary")
    out.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value")).write.option(
        "lineSep", "\x00").option("maxRecordsPerFile", 0).partitionBy("kind").text(target)
    _name_archives(spark, f"{target}/kind=record")
    return read_index(spark, target)


def _name_archives(spark: SparkSession, folder: str) -> None:
    """Give the written members the ending ``.warc.gz``, by which readers know the codec."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        for f in fs.listStatus(root):
            if (old := f.getPath()).getName().endswith(".txt"):
                # part-NNNNN-...: the number has five digits or more
                part = "-".join(old.getName().split("-")[:2])
                if not fs.rename(old, old.getParent().suffix(f"/{part}.warc.gz")):
                    raise OSError(f"{old.toString()} could not be renamed to {part}.warc.gz")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar index of a normalised archive folder."""
    schema = ("part int, seq long, offset long, length long, record_id string, headers map<string,string>")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/kind=index")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.option("lineSep", "\x00").text(f"{target}/kind=index").select(
        F.from_json("value", schema).alias("e")).select("e.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, headers, block_bytes, block_digest, block`` of every record of the archives at ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "headers", "block_bytes", "block_digest", "block"]
        kind = pa.map_(pa.string(), pa.string())

        def batch(rows: list) -> pa.RecordBatch:
            p, h, d = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array([list(x.items()) for x in h], kind), pa.array([len(x) for x in d], pa.int64()),
                 pa.array([hashlib.sha1(x).hexdigest() for x in d]), pa.array(d, pa.binary())], names=names)

        for file, lines in _files(batches):
            rows, size = [], 0
            for headers, _, block in _records(lines):
                rows.append((file, headers, block))
                size += len(block) + 500
                if size > 8_000_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return _lines(spark, path).mapInArrow(
        run, "path string, headers map<string,string>, block_bytes long, block_digest string, block binary")


def archive_pages(pages: DataFrame, folder: str, smallest: int = MIN_SHARED) -> DataFrame:
    """Archive ``pages`` below ``folder``, normalise, read back: one row a page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and ``verified``: a
    response's payload, as read back, has the stated length and digest. Null or
    empty html: an empty response. Equal page_ids give a record each (equal
    payloads included, which refer to no page when they share the largest id); a null
    page_id gives a response without record id. Other columns are not read.
    """
    spark = pages.sparkSession
    write_archives(plan_revisits(pages, smallest), f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/members/kind=record")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                  "verified boolean")
        return spark.createDataFrame([], schema)
    r = read_records(spark, f"{folder}/members/kind=record").drop("block")
    h = F.col("headers")

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(h[name], r"^<urn:page:(-?\d+)>$", 1), F.lit("")).cast("long")

    digest = F.substring_index(h["warc-payload-digest"], ":", -1)
    length = h["warc-payload-length"].cast("long")
    response = h["warc-type"] == "response"
    return r.select(
        page("warc-record-id").alias("page_id"),
        F.when(response, F.col("block_bytes")).otherwise(length).alias("payload_bytes"),
        F.when(response, F.col("block_digest")).otherwise(digest).alias("payload_digest"),
        h["warc-type"].alias("record_type"), page("warc-refers-to").alias("refers_to"),
        F.when(response, (F.col("block_bytes") == length) & (F.col("block_digest") == digest)).otherwise(
            F.lit(True)).alias("verified"))
