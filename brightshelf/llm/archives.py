"""WARC archives: written from rows, read back as a table of chunks.

Each task streams its records into archive files of the shared folder and reports the files it
finished, so files of a lost or repeated task are never read. Reading yields one row per record and
chunk number with the digest of the payload so far; no more than one chunk of a record is held.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from brightshelf.session import materialise, scratch_path

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20  # a new file begins behind this size
LEAST = 1000  # smaller payloads are never revisits
END = b"\r\n\r\n"


def plan_records(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, bytes and refers_to of each row.

    Among equal payloads of `least` bytes or more the largest id is the response that the others
    refer to; rows that share this id are all responses. Null payloads are empty; rows without an
    id refer to an equal payload that has one.
    """
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("bigint"))
    firsts = materialise(
        rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "responses"
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", "bytes", refers.alias("refers_to"))


def _header(record_id: str, row: dict, length: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {row['bytes']}",
    ]
    if row["url"]:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: urn:page:{row['refers_to']}")
    return "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + END


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write planned records; gives (archive, records, bytes) of every finished file."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], names=["archive", "records", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                payload = memoryview(row["html"].encode() if row["refers_to"] is None else b"")
                head = _header(f"<urn:uuid:{uuid.uuid4()}>", row, len(payload))
                out.write(head)
                for at in range(0, len(payload), CHUNK):
                    out.write(payload[at : at + CHUNK])
                out.write(END)
                count, size = count + 1, size + len(head) + len(payload) + len(END)
                if size >= ARCHIVE_BYTES:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    files = records.mapInArrow(run, "archive string, records bigint, bytes bigint")
    return materialise(files, "archives").withColumn("archive", F.concat(F.lit(folder + "/"), F.col("archive")))


def _records(stream, chunk: int) -> Iterator[tuple[dict, int, bytes, str, bool]]:
    """(header, chunk number, data, digest so far, whether it is the last) in file order."""
    buffer = b""
    while True:
        while END not in buffer:
            more = stream.read(1 << 16)
            if not more:
                if buffer.strip():
                    raise ValueError("archive ends inside a record header")
                return
            buffer += more
        head, _, buffer = buffer.partition(END)
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        header = dict(line.split(": ", 1) for line in lines[1:])
        left, number, digest = int(header["Content-Length"]), 0, hashlib.sha1()
        while True:
            want = min(left, chunk)
            if len(buffer) < want:
                buffer += stream.read(want - len(buffer))
            if len(buffer) < want:
                raise ValueError("archive ends inside a payload")
            data, buffer = buffer[:want], buffer[want:]
            digest.update(data)
            left -= want
            yield header, number, data, digest.hexdigest(), left == 0
            number += 1
            if left == 0:
                break
        while len(buffer) < len(END):
            more = stream.read(len(END) - len(buffer))
            if not more:
                raise ValueError("archive ends without a record end")
            buffer += more
        if not buffer.startswith(END):
            raise ValueError("record is longer than its Content-Length")
        buffer = buffer[len(END) :]


CHUNKS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload_length", pa.int64()),
        ("header_digest", pa.string()),
        ("chunk_no", pa.int64()),
        ("data", pa.binary()),
        ("digest", pa.string()),
        ("last", pa.bool_()),
    ]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNKS)], schema=CHUNKS)


def read_chunks(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record and chunk of the listed archives; an empty payload has one empty chunk."""
    if chunk < 1:
        raise ValueError("chunk must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name) as stream:
                    for header, number, data, digest, last in _records(stream, chunk):
                        refers = header.get("WARC-Refers-To")
                        page = header.get("X-Page-ID")
                        rows.append((
                            header["WARC-Record-ID"], header["WARC-Type"], None if page is None else int(page),
                            None if refers is None else int(refers.rsplit(":", 1)[1]), int(header["X-Payload-Length"]),
                            header["WARC-Payload-Digest"].removeprefix("sha1:"), number, data, digest, last,
                        ))
                        held += len(data)
                        if held >= chunk or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = archives.select("archive").repartition(archives.sparkSession.sparkContext.defaultParallelism, "archive")
    return spread.mapInArrow(run, from_arrow_schema(CHUNKS))
