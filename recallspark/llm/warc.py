"""WARC archives with an index: written in tasks, read back by coalesced byte ranges.

Each task writes its records, every one a gzip member of its own, to an archive
file in the shared folder and yields an index row for each: archive, offset, length,
URL and digest. The index is a Parquet table, and only files that it names count: what a
lost attempt wrote stays unread. A reader takes any selection of the index,
sorts it by archive and offset, joins neighbouring records to one range
and fetches that range with one read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes after which a task starts another archive file.
ARCHIVE_BYTES = 256 << 20
#: A range is cut where it would grow beyond this, or where so many unselected bytes lie between two records.
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
#: Archive bytes that a task reads, about; where that gives fewer tasks than there are cores, down to a range each.
TASK_BYTES = 128 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI."""
    if "://" not in folder:
        folder = "file://" + (folder[5:] if folder.startswith("file:") else folder)
    return pafs.FileSystem.from_uri(folder)


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">") if name else ""
    return int(number) if number else None


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> tuple[bytes, str]:
    """A WARC/1.1 response or revisit record (uncompressed) and its payload digest.

    The block of a response is an HTTP message with the payload; that of a revisit is
    the message's head alone, whose Content-Length still tells the payload's size. Blanks and
    control characters of a URL are escaped, a null URL is left out.
    """
    digest = base32_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(data: bytes) -> dict:
    """Fields of one record: the inverse of ``record``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def _writer(folder: str, level: int):
    def write(parts):
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for part in parts:
                rows = []
                for page_id, url, html, original, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    data, digest = record(page_id, url, (html or "").encode("utf-8", "replace"), original, revisit)
                    member = gzip.compress(data, level, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, "revisit" if revisit else "response", page_id))
                    at += len(member)
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "offset", "length", "url", "digest", "record_type", "page_id"]
                )
        finally:
            if out is not None:
                out.close()

    return write


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, original, revisit: which record each page gets.

    Of pages with equal html of at least ``least_bytes`` bytes the one with the smallest page_id is the response.
    Only identifiers and digests are grouped; html moves once, by page_id, to meet the decisions.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    digests = pages.select("page_id", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("size"))
    digests = digests.filter(F.col("size") >= least_bytes).select("page_id", "digest")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original is not null")
    again = digests.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("original")))
    again = again.select(F.col("page_id").alias("p2"), F.col("digest").alias("d2"), "original").distinct()
    own = pages.select("page_id", "url", "html", F.unhex(F.sha1(html)).alias("d"))
    met = own.join(again, F.col("page_id").eqNullSafe(F.col("p2")) & (F.col("d") == F.col("d2")), "left")
    return met.select("page_id", "url", "html", "original", F.col("d2").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 4) -> DataFrame:
    """Write a record for each page below ``folder`` and return the index, a written table."""
    decided = decide(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    return common.materialize(common.map_arrow(decided, _writer(folder, level), INDEX), "warc-index")


def _reader(folder: str, payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")][: None if payload else -1]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORD.split(", ")]

    def fetch(files, path, run):
        archive, start = run[0][0], run[0][1]
        end = max(o + n for _, o, n in run)
        with files.open_input_file(f"{path}/{archive}") as source:
            data = source.read_at(end - start, start)
        return [parse(gzip.decompress(data[o - start : o - start + n])) for _, o, n in run]

    def read(parts):
        files, path = _open(folder)
        run = []

        def batch():
            found = fetch(files, path, run)
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if run and (
                    row[0] != run[-1][0] or row[1] - run[-1][1] - run[-1][2] > GAP_BYTES or row[1] + row[2] - run[0][1] > RANGE_BYTES
                ):
                    yield batch()
                    run = []
                run.append(row)
        if run:
            yield batch()

    return read


def read_records(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the index rows given: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Index rows are dealt by archive and stretch of RANGE_BYTES and sorted by offset, so a task reads
    each stretch with one request, however the selection was made. The number of tasks follows from the bytes
    that the selected records have in the archives, as the index rows themselves are small. A revisit has a null payload; the
    payload's size and digest come from its own head. A response whose digest is wrong fails the job.
    """
    spots = index.select("archive", "offset", "length").withColumn("stretch", F.expr(f"offset div {RANGE_BYTES}"))
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, size // RANGE_BYTES))
    spots = spots.repartition(tasks, "archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch")
    schema = RECORD if payload else RECORD.rpartition(", ")[0]
    return common.map_arrow(spots, _reader(folder, payload), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive all pages and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Pages that repeat the smallest page_id of their
    payload are responses too. A null page_id revisits a page that has one, and is a response where none does. Other columns are ignored.
    """
    folder = common.new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder, least_bytes)
    return read_records(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.read_table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), b AS (
  SELECT page_id, h, x, min(page_id) OVER (PARTITION BY x) AS first_id,
         array_to_string(list_transform(range(1, 41), lambda j:
           substr('0000000100100011010001010110011110001001101010111100110111101111',
                  4 * (strpos('0123456789abcdef', substr(x, j::INT, 1)) - 1) + 1, 4)), '') AS bits
  FROM p
)
SELECT page_id,
       octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
         + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT
         + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b
"""
