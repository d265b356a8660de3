"""WARC: writing archives, a normaliser for monolithic gzip, and reading by offset.

A writer that compresses a whole file as one gzip stream leaves an archive in which nothing can be found without inflating all
that stands before it. The normaliser inflates such a stream once, from front to back, writes every record as a gzip member of
its own, and beside the archive a sidecar index with each record's offset and length. Readers then seek.

Archives are files in a folder that all executors share, on any store that Arrow's file systems open. Each is named by the
task attempt that wrote it and counts only if the attempt's row in the manifest is committed, so lost executors and repeated
attempts leave no half-written archive in a result.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, new_path, small

#: Payloads of at least so many bytes are written once and revisited.
REVISIT_BYTES = 1000
#: Payload bytes after which a writer starts the next archive, records that a reader takes at a time, bytes inflated at a time.
ARCHIVE_BYTES, READ_RECORDS, CHUNK = 64 << 20, 512, 1 << 20


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit holds the response's HTTP head, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}-{digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.encode("unicode_escape").decode("ascii"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_records(read, size: int = CHUNK) -> Iterator[bytes]:
    """Whole records from a reader of inflated bytes; holds one record and a chunk."""
    held = bytearray()
    while True:
        end = held.find(b"\r\n\r\n")
        need = None if end < 0 else end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            continue
        more = read(max(size, (need or 0) - len(held)))
        if not more:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        held += more


def normalise(path: str, out: str, per_range: int = READ_RECORDS) -> tuple[int, int, list[int]]:
    """A gzip archive, of one stream or many -> a member for each record in ``out`` and an index in ``out``.idx.

    The index is a line of JSON for each record: offset, length, page_id. -> (records, bytes of the archive, places in the
    index at which every ``per_range`` records begin, and its end)
    """
    fs, own = store(path)
    to, target = store(out)
    at = n = place = 0
    marks = []
    with fs.open_input_stream(own, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, to.open_output_stream(target, compression=None) as sink, to.open_output_stream(target + ".idx", compression=None) as index:
        for rec in split_records(stream.read):
            member = gzip.compress(rec, 6, mtime=0)
            page = headers(rec[: rec.find(b"\r\n\r\n")]).get("x-page-id", "")
            sink.write(member)
            line = (json.dumps({"offset": at, "length": len(member), "page_id": page}) + "\n").encode()
            index.write(line)
            if n % per_range == 0:
                marks.append(place)
            at, n, place = at + len(member), n + 1, place + len(line)
    return n, at, [*marks, place]


def parse(rec: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, page that a revisit refers to); a payload must fit its digest."""
    end = rec.find(b"\r\n\r\n")
    head, body = headers(rec[:end]), rec[end + 4 : -4]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(headers(http)["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"page {head['x-page-id']}: the payload doesn't fit its digest")
    refers = head.get("x-refers-to-page-id")
    return int(head["x-page-id"]) if head["x-page-id"] else None, size, digest, head["warc-type"], int(refers) if refers else None


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each record holds; refers_to is null for responses.

    Only digests that stand twice are met with the pages, so payloads stay where they are unless these are too many to send.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = Written(large.where("n > 1").select(F.col("digest").alias("_d"), "keeper"), "keepers").df
    known = rows.join(small(keepers), F.col("digest") == F.col("_d"), "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return known.select("page_id", "url", "payload", "digest", F.when(again, F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of ``planned`` -> archives, each one gzip stream; (path, records), committed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        done, out, sink = [], None, None

        def close() -> None:
            sink.write(out.flush())
            sink.close()

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(k) for k in range(5)), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, out, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                data, to = payload.as_py(), refers.as_py()
                kind = "response" if to is None else "revisit"
                sink.write(out.compress(record(kind, page_id.as_py(), url.as_py(), data, digest.as_py(), len(data), to)))
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    done.append((f"{folder}/{name}", n))
                    out = None
        if out is not None:
            close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return Written(rows.mapInArrow(run, "path string, records long"), "manifest").df


def spread(rows: DataFrame, most: int) -> DataFrame:
    """Rows that each stand for much work, over enough tasks for all cores, with at most about ``most`` of them a task.

    The number is named: by the bytes of these short rows, adaptive execution would put them all in one task.
    """
    n = rows.count()
    return rows.repartition(max(1, min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism), -(-n // most)))


def normalise_archives(manifest: DataFrame) -> DataFrame:
    """(path, records) of monolithic archives -> (path, records, marks) of normalised ones, committed; an archive is one task's.

    marks: places in the archive's index at which READ_RECORDS records begin, and its end.
    """
    per_range = READ_RECORDS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for path, records in zip(part["path"], part["records"], strict=True):
                out = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                n, _, marks = normalise(path, out, per_range)
                if n != records:
                    raise ValueError(f"{path} holds {n} records; {records} were written")
                done.append((out, n, marks))
            yield pd.DataFrame(done, columns=["path", "records", "marks"])

    return Written(spread(manifest, 4).mapInPandas(run, "path string, records long, marks array<long>"), "members").df


def read_archives(manifest: DataFrame) -> DataFrame:
    """Normalised archives -> one row a record: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    READ_RECORDS records of an archive are read together: their part of the index, then a seek to each member, which is inflated
    alone.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, begin, end in zip(part["path"], part["begin"], part["end"], strict=True):
                fs, own = store(path)
                with fs.open_input_file(own + ".idx") as f:
                    f.seek(begin)
                    index = [json.loads(x) for x in f.read(end - begin).decode().splitlines()]
                rows = []
                with fs.open_input_file(own) as f:
                    for x in index:
                        f.seek(x["offset"])
                        rows.append(parse(gzip.decompress(f.read(x["length"]))))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})

    ends = F.slice("marks", F.lit(2), F.size("marks"))
    ranges = manifest.where("records > 0").select("path", F.explode(F.arrays_zip(F.slice("marks", F.lit(1), F.size("marks") - 1).alias("begin"), ends.alias("end"))).alias("r"))
    return spread(ranges.select("path", "r.begin", "r.end"), 64).mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for every row, normalises the archives and reads them back: one row a page, from what the files hold.

    Of equal payloads of at least REVISIT_BYTES bytes, rows with the largest page_id are responses and all others revisits of
    it; smaller ones are responses. A null payload is empty; a null page_id is smaller than any other; rows that repeat the
    largest page_id are all responses; an empty table gives an empty result; other columns are ignored. A payload is held in memory
    whole while its record is written or read, and may have up to 2 GB, as a Spark value may.
    """
    folder = new_path(pages.sparkSession, "warc")
    written_ = write_archives(planned(pages, id_col, url_col, payload_col), folder)
    return read_archives(normalise_archives(written_))
