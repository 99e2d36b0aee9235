"""WARC archives, index first.

Writing: payload digests, without the payloads, are grouped to find each payload's first page. Digests of over a
thousandth of all pages are broadcast to them (there are under a thousand of those); the other pages meet their digest's
row in one shuffle of the payloads, and every task writes its pages as gzip-per-record archives of bounded size into a folder that all executors
share, giving an index row (archive, offset, length, url, digest) for each record. Archive names hold the task's number
and not its attempt; an attempt writes under a name of its own and renames at the end, so a task that runs again leaves
the same archives. The index is written as a table before anything is read.

Reading: index rows of the selected records are dealt by ranges of archive and offset to as many tasks as their bytes
ask for, and near ones are read by one ranged read; each record's member is then unpacked and parsed.

Defined results: null html is an empty payload. Null url is an empty target. Repeated rows of the page that others revisit
are response records like it. A page without id is written too, and revisits like others if its payload is another page's. An empty table
gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mapped, shared_dir, stored

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
#: One ranged read spans records this near to each other, up to this many bytes.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Packed bytes of records that one reading task takes: at least and at most, about; between them, three tasks a core.
LEAST_TASK, MOST_TASK = 1 << 20, 64 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
RECORD = "archive string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id: str | None, url: str, payload: bytes, digest: str, kind: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head[2:2] = [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to."""
    p = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    slim = p.select("page_id", "digest", (F.octet_length("payload") >= LEAST_REVISIT).alias("long"))
    first = slim.groupBy("digest").agg(F.min(F.when(F.col("long"), F.col("page_id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.select("digest", F.when(F.col("n") > 1, F.col("first")).alias("first"), "n"), "digests")
    total = first.agg(F.sum("n")).first()[0] or 0
    held = joined(p, first, ("digest",), f"n * 1000 > {total}")
    revisit = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first")) | F.col("page_id").isNull())
    return held.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages' records to archives in the folder; gives the index, as a stored table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        task, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        out, at, name, rows = None, 0, "", []

        def close() -> pd.DataFrame:
            nonlocal out
            out.close()
            out = None
            store.move(f"{top}/{name}.{attempt}", f"{top}/{name}")
            return pd.DataFrame(rows, columns=["archive", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if out is None:
                    store.create_dir(top, recursive=True)
                    name, at, rows = f"part-{task:06d}-{n:04d}.warc.gz", 0, []
                    out, n = store.open_output_stream(f"{top}/{name}.{attempt}", compression=None), n + 1
                page, refers = (None if pd.isna(r.page_id) else r.page_id), (None if pd.isna(r.refers_to) else r.refers_to)
                member = _gzip(_record(page, r.url, r.payload, r.digest, r.record_type, refers))
                out.write(member)
                rows.append((name, at, len(member), r.url, r.digest, page, r.record_type, refers))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return stored(mapped(classified(pages), run, INDEX, "page_id", "refers_to"), "warc-index")


def _parsed(name: str, raw: bytes) -> tuple:
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = lambda urn: urn[10:-1] or None if urn else None
    kind = fields["WARC-Type"]
    return name, page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page(fields.get("WARC-Refers-To")), fields["WARC-Payload-Digest"].removeprefix("sha256:"), payload if kind == "response" else None


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The selected index rows' records: archive, page_id, url, record_type, refers_to, payload_digest, payload (null for revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)

        def read(name: str, run_: list[tuple[int, int]]) -> pd.DataFrame:
            low, high = run_[0][0], run_[-1][0] + run_[-1][1]
            with store.open_input_file(f"{top}/{name}") as f:
                data = f.read_at(high - low, low)
            rows = [_parsed(name, zlib.decompress(data[o - low : o - low + n], 31)) for o, n in run_]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

        name, ranges = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if ranges and (r.archive != name or r.offset > sum(ranges[-1]) + GAP or r.offset + r.length - ranges[0][0] > READ_BYTES):
                    yield read(name, ranges)
                    ranges = []
                name = r.archive
                ranges.append((r.offset, r.length))
        if ranges:
            yield read(name, ranges)

    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // MOST_TASK), min(-(-total // LEAST_TASK), 3 * cores))
    wanted = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return mapped(wanted, run, RECORD, "page_id", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as read back; a revisit's payload is that of the record it refers to."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(pages, folder)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            payloads = list(pdf["payload"])
            yield pdf[["page_id", "record_type", "refers_to", "payload_digest"]].assign(
                n=pd.array([None if p is None else len(p) for p in payloads], "Int64"), d=[None if p is None else hashlib.sha256(p).hexdigest() for p in payloads])

    read = stored(mapped(read_records(index, folder), digests, "page_id long, record_type string, refers_to long, payload_digest string, n long, d string", "page_id", "refers_to"), "warc-read")
    whole = read.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("p"), F.col("d").alias("pd")).agg(F.max("n").alias("pn"))
    held = read.join(whole, F.expr("refers_to = p and payload_digest = pd"), "left")
    return held.select("page_id", F.coalesce("n", "pn").alias("payload_bytes"), F.coalesce("d", "pd").alias("payload_digest"), "record_type", "refers_to")
