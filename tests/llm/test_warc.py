import gzip
import hashlib

import pytest

from linkweave.llm.warc import archive_round_trip, chunked, page_records, parse_records, read_archives, unchunked
from tests.llm.samples import rows

BIG = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 9000 + "</p>"
PAGES = [
    (3, "http://a/", "x" * 200), (1, "http://b/ c\r\nX: y", "x" * 200), (2, None, "x" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"),
    (7, "u", "short"), (8, "u", BIG), (9, "u", BIG + "."), (10, "u", BIG), (None, "u", "n" * 150), (None, "v", "n" * 150), (11, "w", "r" * 100),
    (11, "w", "r" * 100), (None, "u", "x" * 200), (12, "u", "z" * 99), (13, "u", "z" * 99), (14, "u", "s" * 50_000), (14, "u", "s" * 50_000),
]
NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def frame(spark, data):
    return spark.createDataFrame([(*p, "x") for p in data], "page_id bigint, url string, html string, digest string")


def brute(data):
    out = []
    for page, _, html in data:
        body = (html or "").encode()
        same = [p for p, _, h in data if (h or "").encode() == body and p is not None] if len(body) >= 100 else []
        first = min(same) if same else page
        revisit = page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_round_trip(spark):
    found = archive_round_trip(frame(spark, PAGES))
    assert rows(found, *NAMES) == brute(PAGES) and not [r for r in found.collect() if r["error"]]


def test_small_segments_and_files(spark):
    found = archive_round_trip(frame(spark, PAGES), segment_bytes=700, records_per_file=2)
    assert rows(found, *NAMES) == brute(PAGES)


def test_empty_table(spark):
    assert archive_round_trip(frame(spark, [])).collect() == []


def test_faults_are_reported(spark, tmp_path):
    body = b"0123456789" * 100
    digest = hashlib.sha256(body).hexdigest()
    whole = page_records(0, 1, "u", body, digest, None, segment_bytes=300)
    blocks = [b"WARC/1.1" + b for b in whole.split(b"WARC/1.1")[1:]]
    (tmp_path / "part-0.warc").write_bytes(b"".join(blocks[:1] + blocks[2:]))
    (tmp_path / "part-1.warc.gz").write_bytes(b"".join(map(gzip.compress, page_records(1, 2, "u", body, "0" * 64, None).split(b"\0")[:1])))
    other = page_records(2, 3, "u", body, digest, None, segment_bytes=300)
    (tmp_path / "part-2.warc").write_bytes(other.replace(b"Total-Length: ", b"Total-Length: 9"))
    late = page_records(3, 4, "u", body, digest, None, segment_bytes=300).split(b"WARC/1.1")[1:]
    (tmp_path / "part-3.warc").write_bytes(b"".join(b"WARC/1.1" + b for b in reversed(late)))
    errors = {r["page_id"]: r["error"] for r in read_archives(spark, str(tmp_path)).collect()}
    assert errors == {1: "segments missing or repeated", 2: "digest differs", 3: "total length differs", 4: None}


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunked_framing(size):
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 5):
        assert unchunked(chunked(body, size)) == body
    assert unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_records_parse_back():
    found = list(parse_records(page_records(1, 5, "http://x/", b"hi", "d", None)))
    assert found[0][0]["x-page-id"] == "5" and len(found) == 1
