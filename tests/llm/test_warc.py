import hashlib
import struct

from pyarrow import fs

from veilframe.llm import warc
from veilframe.llm.common import new_path

KIND = "page_id long, url string, html string, digest string"


def rows():
    long_ = "<p>" + "été " * 100 + "</p>"
    return [(1, "http://a/\r\nx: y", long_, "d"), (2, None, long_, None), (3, "http://c", "short", None), (4, "u", "short", None), (5, "u", None, None), (6, "u", "", None), (7, "u", "\r\n\r\n" * 60, None), (0, "u", long_, None), (-8, "u", "\r\n\r\n" * 60, None)]


def test_round_trip(spark):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows(), KIND).repartition(3)).collect()}
    first = {}
    for k, _, h, _ in sorted(rows()):
        first.setdefault(h or "", k)
    expected = {}
    for k, _, h, _ in rows():
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != k
        expected[k] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None)
    assert got == expected


def test_null_ids_stay_null(spark):
    long_ = "x" * 200
    table = [(None, "u", long_, None), (-1, "u", long_, None), (None, "u", "short", None), (5, "u", long_, None), (5, "u", long_, None)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(table, KIND)).collect()), key=str)
    assert got == sorted([(None, "response", None), (-1, "response", None), (None, "response", None), (5, "revisit", -1), (5, "revisit", -1)], key=str)


def test_archive_format(spark):
    folder = new_path(spark, "warc")
    made = warc.write_archives(spark.createDataFrame(rows() * 20, KIND).coalesce(1), folder).collect()
    files, _ = fs.FileSystem.from_uri(folder)
    assert sum(r.records for r in made) == 20 * len(rows())
    for r in made:
        with files.open_input_stream(r.path) as f:
            magic, size = struct.unpack("<II", f.read(8))
            assert magic == warc.SKIPPABLE_MAGIC and size <= warc.DICTIONARY_BYTES
        assert all(raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") for raw in warc.read_archive(files, r.path))


def test_ids_are_kept_in_urns():
    for k in (0, 1, -1, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_urn(k)) == k


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], KIND)).collect() == []
