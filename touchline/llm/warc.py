"""WARC archives in Zstandard: writer, and a reader for ``.warc.zst``.

An archive starts with a skippable frame that holds its dictionary, and then has one
Zstandard frame per record. The reader loads the dictionary from the leading skippable
frame (compressed or not), decodes one frame per record and checks the version line,
the header syntax, the lengths and the payload digest; a record that fails raises.

Archives hold at most ``ARCHIVE_BYTES`` of records (a longer record has one of its own)
and are written under fresh names, which the task reports in a manifest: only a finished
task's archives are in it, so a lost executor leaves at most unread files. Archives go to
the shared folder through Arrow's file systems (file, hdfs, s3, gs). Reading holds one
record at a time.

Of records with equal payloads of at least ``REVISIT_BYTES`` that with the smallest page
id is the response and the others are revisits of it; first ids are pre-aggregated by
digest, and only digests that occur twice are joined back.

Edge cases: a null payload is empty; a null page id is never referred to (if all ids of a
group are null all its records are responses); pages that repeat a page id and payload are
all responses if that id is the smallest; control characters in a url are percent-coded;
an empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, met, parts_for, shared_path, stored

DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
REVISIT_BYTES = 100
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record: a response with an HTTP block, or a revisit without payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The bytes of one archive: dictionary frame, then a frame per record."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step]).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: raw content serves as one
        trained = max(records[:64], key=len)[:DICTIONARY_BYTES]
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    for r in records:
        yield coder.compress(r)


class Stream:
    """Reads frames one by one from a binary file."""

    def __init__(self, file, chunk: int = 1 << 18):
        self.file, self.chunk, self.rest = file, chunk, b""

    def peek(self, n: int) -> bytes:
        while len(self.rest) < n and (more := self.file.read(self.chunk)):
            self.rest += more
        return self.rest[:n]

    def take(self, n: int) -> bytes:
        if len(self.peek(n)) < n:
            raise ValueError("archive ends inside a frame")
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def frame(self, coder) -> bytes:
        """The content of the next frame."""
        decoder, out = coder.decompressobj(), []
        while not decoder.eof:
            if not self.peek(1):
                raise ValueError("archive ends inside a frame")
            out.append(decoder.decompress(self.rest))
            self.rest = decoder.unused_data if decoder.eof else b""
        return b"".join(out)


def frames(file) -> Iterator[bytes]:
    """Each record of an archive, decoded with its dictionary."""
    import zstandard

    stream, dictionary = Stream(file), None
    head = stream.peek(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        stream.take(8)
        dictionary = stream.take(struct.unpack("<I", head[4:])[0])
        if dictionary[:4] == ZSTD_FRAME:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while lead := stream.peek(8):
        if len(lead) == 8 and 0x184D2A50 <= struct.unpack("<I", lead[:4])[0] <= 0x184D2A5F:  # later skippable frames hold no record
            stream.take(8)
            stream.take(struct.unpack("<I", lead[4:])[0])
            continue
        if lead[:4] != ZSTD_FRAME:
            raise ValueError("not a Zstandard frame")
        yield stream.frame(coder)


def parsed(raw: bytes) -> dict:
    """Headers and payload of one record, validated."""
    import hashlib

    head, cut, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not cut or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ValueError(f"{needed} is missing")
    size = int(headers["content-length"])
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block doesn't have the stated length")
    http, cut, payload = rest[:size].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not cut or length is None:
        raise ValueError("the HTTP block has no length")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if headers["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its length or digest")
    own = lambda k: (headers.get(k, "").removeprefix("<urn:page:").removesuffix(">")) or None
    return {
        "page_id": own("warc-record-id"), "url": headers.get("warc-target-uri"), "record_type": headers["warc-type"],
        "payload_bytes": length, "payload_digest": digest, "refers_to": own("warc-refers-to"), "payload": payload,
    }


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str, archive_bytes: int):
    def flush(records: list[bytes]) -> pa.RecordBatch:
        path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, at = _file_system(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        with system.open_output_stream(at, compression=None) as out:
            for piece in archive(records):
                out.write(piece)
        return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(records)], pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i) for i in range(b.num_columns))):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in row)
                r = record(page_id, url, payload, digest, kind, refers_to)
                if held and size + len(r) > archive_bytes:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield flush(held)

    return run


def _reader(with_payload: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, at = _file_system(path)
                rows, size, seen = [], 0, 0
                pack = lambda rows: pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in keys})
                with system.open_input_stream(at, compression=None) as file:
                    for raw in frames(file):
                        rows.append(parsed(raw) if with_payload else parsed(raw) | {"payload": None})
                        size, seen = size + len(raw) * with_payload + 200, seen + 1
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{path} has {seen} records, not {count}")
                if rows:
                    yield pack(rows)

    return run


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to) of every page."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"),
        F.sha2(html, 256).alias("digest"), F.col(id_col).alias("__id"),
    )
    # short payloads have no first, but are listed: equal ones are many rows of one digest, too, and are dealt out
    long = F.when(F.octet_length("payload") >= least, F.col("__id"))
    firsts = rows.groupBy(F.col("digest").alias("__key")).agg(F.min(long).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    joined = met(rows, "digest", ["page_id", "url"], firsts, pages.count(), "left")
    revisit = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("__first").cast("string")).alias("refers_to"),
    )


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **cols) -> DataFrame:
    """Write the pages as archives; returns the manifest (path, records)."""
    bounded_batches(spark)
    folder = folder or shared_path(spark, "warc")
    rows = classified(pages, **cols)
    return stored(spark, rows.mapInArrow(lean(_writer(folder, archive_bytes)), "path string, records long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in the manifest; ids are strings, as in the headers."""
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    schema += ", payload binary" * with_payload
    return manifest.select("path", "records").repartition(parts_for(spark), "path").mapInArrow(lean(_reader(with_payload)), schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = read_archives(spark, manifest, with_payload=False)
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""
