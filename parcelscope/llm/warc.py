"""WARC archives of pages: one gzip member per record, and a sequential reader.

Writer tasks append records to archives of bounded size in the shared folder and return one row per finished
archive; only archives in the committed manifest count, so a retried task leaves at most an unlisted file. The reader takes an
archive from its start with an incremental inflater, one member at a time in bounded reads, frames each record by its
Content-Length and holds payloads against the digest in the header; a mismatch or a cut record raises.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response, the others
are revisits that name it; shorter payloads are always responses. Null html is an empty payload. Rows that repeat
a page_id are records of their own; where they are the smallest id of a payload, all of them are responses. Null ids
come last. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import cut, scratch

READ = 1 << 18
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def record(page_id, url: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + member.flush()


def write_archives(pages: DataFrame, folder: str, *, least: int = 100, roll: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives below ``folder``; the manifest: ``path, records, bytes``."""
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id")
    shared = page.filter(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    # the join deals pages by digest; a payload that a third of the pages share is a skewed partition that adaptive execution splits
    joined = page.join(shared.select("digest", "first"), "digest", "left")
    marked = joined.withColumn("revisit", F.col("first").isNotNull() & (order != F.col("first"))).withColumn("refers_to", F.when(F.col("revisit"), F.col("first.page_id")))

    def write(batches):
        import uuid

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path)
                data = record(r["page_id"], r["url"].replace("\r", "").replace("\n", ""), r["html"].encode(), r["digest"], r["refers_to"], r["revisit"])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    out = None
                    yield _manifest(path, n, size)
        if out is not None:
            out.close()
            yield _manifest(path, n, size)

    listed = marked.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(write, "path string, records long, bytes long")
    return cut(listed, "warc_manifest")


def _manifest(path: str, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    pending = b""
    while True:
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not pending:
                pending = stream.read(READ)
                if not pending:
                    if out or inflate.unconsumed_tail:
                        raise ValueError("archive ends within a record")
                    return
            out.append(inflate.decompress(pending))
            pending = inflate.unused_data if inflate.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Type, ids, digest and payload length of a record; raises where framing or digest are wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines)
    size = int(field["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("record's length differs from its Content-Length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = field["WARC-Payload-Digest"].removeprefix("sha256:")
    if field["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    refers = _page(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None
    return {"page_id": _page(field["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": refers, "payload": payload}


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    fields = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(path) as stream:
                    for data in members(stream):
                        rows.append({k: v for k, v in parse(data).items() if k != "payload"})
                        seen += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows = []
                if seen != n:
                    raise ValueError(f"{path} has {seen} records; the manifest says {n}")
                yield pa.RecordBatch.from_pylist(rows, schema=fields)

    # archives are dealt out evenly by number: left to adaptive execution, a small manifest would be one task
    tasks = min(manifest.count(), max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4)
    return manifest.select("path", "records").repartition(max(1, tasks)).mapInArrow(read, _RECORD)


def round_trip(pages: DataFrame, *, least: int = 100) -> DataFrame:
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, least=least), folder)
