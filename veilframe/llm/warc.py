"""WARC archives with one Zstandard frame a record and a shared dictionary."""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import cut, group_min, new_path, partitions

#: Records with payloads of at least so many bytes may be revisits.
MIN_REVISIT = 100
#: The dictionary's size, and the most records and bytes of each it is built from.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 1 << 16, 400, 1 << 14
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 1 << 28
LEVEL = 3
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_SPACE = 0x6F1D0C3A52B84E90 << 64

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_urn(page_id: int | None) -> str:
    """The id as the low half of a UUID; a null id has a high half of its own."""
    number = _SPACE | 1 << 64 if page_id is None else _SPACE | page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=number)}>"


def page_of(urn: str) -> int | None:
    number = uuid.UUID(urn[len("<urn:uuid:") : -1]).int
    low = number & (1 << 64) - 1
    return None if number >> 64 & 1 else low - (1 << 64) if low >> 63 else low


def one_line(value: str) -> str:
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a response record, or of a revisit of page `refers_to`."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page_id)}", f"WARC-Date: {DATE}"]
    if one_line(url):
        head.append(f"WARC-Target-URI: {one_line(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class ArchiveWriter:
    """Archives in one folder: a skippable frame with the dictionary, then a frame
    for each record. A new archive begins once one is full."""

    def __init__(self, folder: str, dictionary: bytes):
        import zstandard

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.dictionary, self.out, self.done = dictionary, None, []
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"  # each attempt of a task has files of its own
            self.out = self.fs.open_output_stream(self.path)
            head = struct.pack("<II", SKIPPABLE_MAGIC, len(self.dictionary)) + self.dictionary
            self.out.write(head)
            self.size, self.records = len(head), 0
        frame = self.compressor.compress(raw)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.records, self.size))
            self.out = None


def read_archive(files: fs.FileSystem, path: str):
    """The records' bytes of one archive, in order, from the file alone."""
    import zstandard

    with files.open_input_stream(path) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != SKIPPABLE_MAGIC:
            raise ValueError("the archive has no leading dictionary frame")
        dictionary = stream.read(size)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        rest = b""
        while True:
            rest = rest or stream.read(1 << 16)
            if not rest:
                return
            frame, parts = reader.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = stream.read(1 << 16)
                if not rest:
                    raise EOFError("the archive ends inside a record")
            yield b"".join(parts)


def build_dictionary(pages: DataFrame, ident: str, url: str, html: str) -> bytes:
    """A Zstandard dictionary from a bounded sample of records, chosen by hash. Rows far
    from the smallest hashes are left out first, so tasks send few to the driver."""
    import zstandard

    near = F.pmod(F.xxhash64(F.lit("dictionary"), F.col(ident)), F.lit(1 << 30)) < F.lit(max(1, pages.count()) ** -1 * 4 * SAMPLE_RECORDS * (1 << 30))
    some = pages.where(F.coalesce(near, F.lit(False))).select(F.col(ident), F.col(url), F.substring(F.coalesce(F.col(html), F.lit("")), 1, SAMPLE_BYTES)).orderBy(F.xxhash64(F.col(ident)), F.col(ident)).limit(SAMPLE_RECORDS)
    raws = [record(p, u, h.encode(), "0" * 64, None) for p, u, h in some.collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, raws)) // 8), raws).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def revisits(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat an earlier payload."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    keys = cut(pages.select(F.col(ident).alias("page_id"), F.sha2(payload, 256).alias("digest")).where(F.octet_length(payload) >= MIN_REVISIT), "digests")
    return group_min(keys, "digest", "page_id").where("leader <> page_id").select("page_id", "digest", F.col("leader").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row and return (path, records, bytes) of the archives.

    Null html is an empty payload. Rows with equal payloads of MIN_REVISIT bytes
    or more: the smallest id is written as a response, the others as revisits of
    it; rows that repeat that id are responses too, and so is a row with a null id,
    which comes back as null. An empty table writes nothing. Other columns are ignored.
    The dictionary (at most DICTIONARY_BYTES) is all that is sent to every task.
    """
    dictionary = build_dictionary(pages, ident, url, html)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    again = revisits(pages, ident, html).withColumnsRenamed({"page_id": "_p", "digest": "_d"})
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(again, (F.col("page_id") == F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        writer = ArchiveWriter(folder, dictionary)
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1))), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                page, link, body, digest, first = values
                writer.write(record(page, link, body.as_buffer().to_pybytes(), digest, first))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*writer.done, strict=True)], names=["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every
    record in the archives; a response's digest is that of the bytes read."""

    def run(batches):
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = ([], [], [], [], [])
                for raw in read_archive(files, path):
                    fields, http, payload = parse(raw)
                    kind = fields["WARC-Type"]
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                    if kind == "response":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"record {fields['WARC-Record-ID']} has another payload than its digest says")
                    first = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    for to, x in zip(out, (page_of(fields["WARC-Record-ID"]), size, digest, kind, first), strict=True):
                        to.append(x)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.repartition(partitions(spark)).mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives to the shared folder and read every record back.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to), one row
    per row. Null html is an empty payload, a null url is left out, null ids stay
    null and are responses; rows that repeat an id are records of their own. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, ident, url, html), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                  strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
