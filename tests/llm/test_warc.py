import base64
import gzip
import hashlib
import random

import pytest

from tidewatt.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, record_type int"
PAYLOADS = [None, "", "<p>a</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "é😀", "\r\n\r\n", "b" * 20000, "line\nline"]


def pages():
    r = random.Random(1)
    rows = [(i, r.choice(["http://a/é", None, "http://b\r\nX: y", ""]), r.choice(PAYLOADS)) for i in range(60)]
    rows += [(None, "http://c", "only without id"), (None, None, "b" * 20000), rows[5], (100, "http://d", f"unique {'z' * 70000}")]
    return [(*row, "x", 1) for row in rows]


def brute(rows, least):
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        first = min((p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None), default=None)
        again = len(body) >= least and page != first
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


@pytest.mark.parametrize("least, file_bytes", [(0, 16 << 20), (5, 4000)])
def test_round_trip(spark, least, file_bytes):
    rows = pages()
    made = warc.archive_digest(spark.createDataFrame(rows, SCHEMA), least_bytes=least, file_bytes=file_bytes).collect()
    assert sorted(map(repr, map(tuple, made))) == sorted(map(repr, brute(rows, least)))


def test_files_are_archives(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA), path, date="2025-01-01T00:00:00Z", file_bytes=30_000)
    files = [p.read_bytes() for p in (tmp_path / "out").glob("part-*.gz")]
    assert len(files) > 2
    seen = [(f, b) for content in files for f, b in warc.parse(gzip.decompress(content))]
    assert len(seen) == len(pages())
    for fields, block in seen:
        assert int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Record-ID"].startswith("<urn:uuid:") and fields["WARC-Date"]
        assert ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit") == (fields.get("WARC-Profile") == warc.REVISIT)
    read = warc.read_archives(spark, path)
    assert sorted(r.payload for r in read.where("record_type = 'response'").collect())[-1].startswith(b"\xc3")
    assert read.where("record_type = 'response' AND declared <> payload_digest").count() == 0


def test_empty_table(spark):
    assert warc.archive_digest(spark.createDataFrame([], SCHEMA)).count() == 0
