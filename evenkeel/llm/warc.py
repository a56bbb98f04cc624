"""WARC archives: a deterministic sharded writer, and the reader.

Pages are range-sorted by id; every task writes the records of its range to files
that roll when their compressed size reaches a limit. A file is written under a
temporary name and renamed when it is whole; where an earlier attempt has left the same bytes under
the final name, that file stays as it is. The manifest, written by Spark,
names every file with its records, bytes and SHA-1. Only files in a finished
manifest count. Payloads are shuffled once: what makes a page a revisit travels in a row of
its own that sorts before the page. Dates, ids and order depend on the pages alone, so a task that runs
again writes the same bytes under the same names.

Of pages with equal payloads of ``at_least`` bytes or more the one with the largest
id is a response, the others are revisits of it. A revisit carries the headers
of the response (with the payload's length) and its digest, not the payload.

A NULL page is an empty payload. A NULL url leaves out the target. Pages with
a NULL id sort first and are responses. Rows that repeat the largest id of their
payload are responses too. No pages make no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import attach, bounded_batches, scratch, written

ROLL_BYTES = 64 << 20
MANIFEST = "file string, records long, bytes long, sha1 string, first_id long, last_id long"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record: str) -> int | None:
    number = record.strip("<>").split(":")[2]
    return int(number) if number else None


def header(pairs: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def member(head: bytes, block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32(hashlib.sha1(payload).digest())
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    if refers_to is None:
        block += payload
    pairs = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        pairs.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        pairs += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", REVISIT)]
    pairs += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return member(header(pairs), block)


def info_record(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return member(
        header(
            [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:archive:{name}>"),
                ("WARC-Date", DATE),
                ("WARC-Filename", name),
                ("Content-Type", "application/warc-fields"),
                ("Content-Length", str(len(block))),
            ]
        ),
        block,
    )


class Roll:
    """The files of one range, one after the other."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.part, self.limit, self.seq = part, roll_bytes, 0
        self.out = None

    def add(self, page_id: int | None, record: bytes) -> dict | None:
        """Write a record; what the manifest says of the file if that was its last."""
        if self.out is None:
            self.name = f"pages-{self.part:06d}-{self.seq:06d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha1, self.bytes, self.records, self.first = hashlib.sha1(), 0, 0, page_id
            self._put(info_record(self.name))
        self._put(record)
        self.records, self.last = self.records + 1, page_id
        return self.close() if self.bytes >= self.limit else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def _sha1_of(self, path: str) -> str | None:
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        sha1 = hashlib.sha1()
        with self.fs.open_input_stream(path, compression=None) as stream:
            while data := stream.read(1 << 20):
                sha1.update(data)
        return sha1.hexdigest()

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.seq = None, self.seq + 1
        final = f"{self.root}/{self.name}"
        there = self._sha1_of(final)
        if there == self.sha1.hexdigest():
            self.fs.delete_file(self.temporary)
        else:
            if there:
                self.fs.delete_file(final)  # cut off, or of another run
            self.fs.move(self.temporary, final)
        return {
            "file": self.name,
            "records": self.records,
            "bytes": self.bytes,
            "sha1": self.sha1.hexdigest(),
            "first_id": self.first,
            "last_id": self.last,
        }


def revisits(pages: DataFrame, at_least: int) -> DataFrame:
    """page_id and payload_sha1 of the pages that are no responses, with the page they refer to."""
    facts = pages.select("page_id", "payload_sha1", F.octet_length("payload").alias("size"))
    facts = facts.filter((F.col("size") >= at_least) & F.col("page_id").isNotNull()).drop("size")
    groups = facts.groupBy("payload_sha1").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count("*").alias("n")
    )
    shared = written(groups.filter("low <> refers_to").drop("low"), "payloads")
    # a payload that many pages have is not left to one task
    return attach(facts, shared, "payload_sha1").filter("page_id <> refers_to").distinct()


def write_warc(
    pages: DataFrame,
    folder: str,
    at_least: int = 0,
    roll_bytes: int = ROLL_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write the archives to ``folder`` (a URI every executor can reach); the manifest."""
    bounded_batches()
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    ).withColumn("payload_sha1", F.sha1("payload"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = f"{folder.rstrip('/')}/_manifest"
    key = ("page_id", "payload_sha1")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done, about, refers_to = None, [], None, None
        for batch in batches:
            for page_id, sha1, url, data, target, part in zip(*batch.columns):
                page_id, sha1, data = page_id.as_py(), sha1.as_py(), data.as_py()
                if data is None:
                    about, refers_to = (page_id, sha1), target.as_py()
                    continue
                if roll is None:
                    roll = Roll(folder, part.as_py(), roll_bytes)
                other = refers_to if about == (page_id, sha1) else None
                entry = roll.add(page_id, page_record(page_id, url.as_py(), data, other))
                done += [entry] if entry else []
        if roll and (entry := roll.close()):
            done.append(entry)
        schema = pa.schema(
            [
                ("file", pa.string()),
                ("records", pa.int64()),
                ("bytes", pa.int64()),
                ("sha1", pa.string()),
                ("first_id", pa.int64()),
                ("last_id", pa.int64()),
            ]
        )
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    with scratch():
        facts = revisits(rows, at_least)
        both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(facts, allowMissingColumns=True)
        # rows of one key are in one range, its fact before its pages
        both = both.repartitionByRange(parts, *key).sortWithinPartitions(*key, F.col("payload").isNotNull(), "url")
        both = both.select(*key, "url", "payload", "refers_to", F.spark_partition_id().alias("part"))
        both.mapInArrow(write, MANIFEST).write.parquet(manifest)
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{root}/_temporary")  # of attempts that were lost
    return spark.read.schema(MANIFEST).parquet(manifest)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def page_row(fields: dict[str, str], block: bytes, payloads: bool) -> dict | None:
    """What a page's record says, its digests checked; None for other records."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    if fields["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"block of {fields['warc-record-id']} does not have its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    refers_to = None
    if kind == "response":
        if len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    else:
        refers_to = page_of(fields["warc-refers-to"])
    return {
        "page_id": page_of(fields["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
        "payload": payload if payloads and kind == "response" else None,
    }


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row for each page record of the archives that the manifest of ``folder`` names.

    Files are streamed; a task holds one record at a time.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for fields, block in records(io.BufferedReader(stream, 1 << 20)):
                        row = page_row(fields, block, payloads)
                        if row is None:
                            continue
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.select("file").repartition(parts, "file").mapInArrow(read, ROWS)
