"""WARC archives with Zstandard dictionaries.

Each partition writes its records to files of at most FILE_BYTES payload. For each file a
dictionary is built from records in it; it stands in a leading skippable frame, and each record
is one frame, compressed with it, so records can be read one by one. Of records with equal payloads
one is a response and the others revisit it. Files go through the store's own file system
(pyarrow), under a name that is unique to the attempt and renamed at the end.

Cases: null html is an empty payload; the response of equal payloads is the row with the smallest
page_id (a null id only if all are null), and rows that repeat that id are responses too; payloads below the limit are always responses; a
null url is an empty target; an empty table writes no file; further columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean_batches, work_folder

#: Payload bytes of one file, and of the records that its dictionary is built from.
FILE_BYTES = 24 << 20
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
LEVEL = 3
#: First bytes of the skippable frame that holds a dictionary.
FRAME = 0x184D2A5D
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, also under the names that Hadoop has for it."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if uri.startswith(ours):
            uri = theirs + uri[len(ours) :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _record_id(page_id, sha: str, revisit: bool) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha} {revisit}')}>"


def _line(text: str) -> str:
    return " ".join(text.split())


def record(page_id, url, payload: bytes, sha: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. The page's id travels as a header of its own."""
    n = len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, sha, revisit)}"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {n}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, sha, False)}", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {n}\r\n\r\n".encode() + (b"" if revisit else payload)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The headers of one record, with its payload under "payload"."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train from, the records' own bytes."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICT_BYTES:]


def pack(records: list[bytes]) -> bytes:
    words = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
    return struct.pack("<II", FRAME, len(words)) + words + b"".join(packer.compress(r) for r in records)


def unpack(content: bytes):
    """The records of one archive."""
    magic, size = struct.unpack_from("<II", content)
    if magic != FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    rest = memoryview(content)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        raw = one.decompress(rest)
        yield raw
        rest = rest[len(rest) - len(one.unused_data) :]


def _write(folder: str):
    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        waiting, size, done = [], 0, []

        def flush():
            nonlocal waiting, size
            name = f"{uuid.uuid4().hex}.warc.zst"
            content = pack(waiting)
            with store.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(content)
            store.move(f"{root}/.{name}", f"{root}/{name}")
            done.append((f"{folder}/{name}", len(waiting), len(content)))
            waiting, size = [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit")]
            for page, url, html, sha, first, revisit in zip(*columns, strict=True):
                waiting.append(record(page, url, (html or "").encode(), base64.b32encode(bytes.fromhex(sha)).decode(), first, revisit))
                size += len(waiting[-1])
                if size >= FILE_BYTES:
                    flush()
        if waiting:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the archives, one record for each row, and returns path, n_records and n_bytes of each file."""
    spark = pages.sparkSession
    folder = folder or work_folder(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    firsts = hashed.groupBy("digest").agg(F.min("page_id").alias("first"))
    linked = hashed.join(firsts, "digest")
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = linked.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))
    files = rows.mapInArrow(lean_batches(_write(folder)), "path string, n_records long, n_bytes long")
    manifest = f"{folder}-files"
    files.write.parquet(manifest)  # files of attempts that did not count are not listed
    return spark.read.schema(files.schema).parquet(manifest)


def read(files: DataFrame) -> DataFrame:
    """The records of the archives that files lists."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    content = f.read()
                rows = []
                for raw in unpack(content):
                    r = parse(raw)
                    number = lambda x: int(x) if x else None
                    revisit = r["WARC-Type"] == "revisit"
                    payload, sha = r["payload"], r["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != sha:
                        raise ValueError(f"{path}: a payload does not match its digest")
                    n = int(r["X-Payload-Length"]) if revisit else len(payload)
                    rows.append((number(r["X-Page-Id"]), r["WARC-Target-URI"], n, sha, r["WARC-Type"], number(r.get("X-Refers-To-Page-Id")), payload))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path").mapInArrow(lean_batches(run), RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
