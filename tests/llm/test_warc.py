import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from voxelweave.llm import warc as A

KIND = "page_id bigint, url string, html string, payload_digest int, revisit string, nonce string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], KIND)


def rows():
    body = "<p>" + "é漢🙂" * 30 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    out = [(i, f"http://h{i % 3}.example.com/p {i}\r\nX: y", f"<html>{i}" + "ab\n" * (i % 50) + "</html>") for i in range(60)]
    out += [(100 + i, "http://x.example.com/", body) for i in range(40)] + [(99, None, body), (200, "u", None), (201, "u", ""), (202, "", "tiny"), (203, "", "tiny"), (204, "u", "z" * 200000)]
    out += [(300, "u", "r" * 150), (300, "u", "r" * 150), (301, "u", "r" * 150), (None, "u", "n" * 120), (400, "u", "n" * 120)]
    return out


def brute(data):
    first = {}
    for pid, _, html in data:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, float("inf")), float("inf") if pid is None else pid)
    out = []
    for pid, _, html in data:
        b = (html or "").encode()
        again = len(b) >= 100 and pid != first[b] and not (pid is None and first[b] == float("inf"))
        out.append((pid, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", int(first[b]) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [A.BROADCAST_ROWS, 0])
def test_round_trip(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(A, "CLASSES", ((100, 7), (300, 3), (None, 1)))
    monkeypatch.setattr(A, "BROADCAST_ROWS", broadcast_rows)
    data = rows()
    captures = A.archive_pages(pages(spark, data))
    assert sorted(map(tuple, A.capture_digest(captures).collect()), key=repr) == brute(data)
    bodies = {(r["metadata"]["fields"]["page-id"], r["response"]["payload"]) for r in captures.where("response.type = 'response'").collect()}
    assert ("204", "z" * 200000) in bodies
    got = captures.select("capture_id", "response.refers_to_id", "request.type", F.col("metadata.fields")["page-id"].alias("page"), F.col("metadata.fields")["refers-to-page"].alias("first")).collect()
    assert len(got) == len(data) and all(r["type"] == "request" for r in got)
    page_of = {r["capture_id"]: r["page"] for r in got}
    assert len(page_of) == len(data) and all(page_of[r["refers_to_id"]] == r["first"] for r in got if r["refers_to_id"])
    assert sum(bool(r["refers_to_id"]) for r in got) == 41  # page 300 occurs twice, so its record is not named


def test_targets_are_encoded(spark):
    got = A.archive_pages(pages(spark, [(1, "http://a/b c\r\nX: y\x7f%20é", "t")])).select("response.target").collect()
    assert got[0][0] == "http://a/b%20c%0D%0AX:%20y%7F%20é"


def test_large_pages_in_files_of_their_own(spark):
    data = [(i, "u", chr(97 + i % 26) * (600_000 + 100_000 * i)) for i in range(10)] + [(50 + i, "u", "s" * (200 + i)) for i in range(30)]
    captures = A.archive_pages(pages(spark, data))
    assert sorted(map(tuple, A.capture_digest(captures).collect()), key=repr) == brute(data)


def test_orphans_stay(spark):
    records = spark.createDataFrame([("request", "<r>", "<a>"), ("metadata", "<m>", "<b>"), ("response", "<a>", None), ("revisit", "<c>", None)], "type string, record_id string, concurrent_to string")
    got = {r["capture_id"]: (bool(r["response"]), bool(r["request"]), bool(r["metadata"])) for r in A.assemble(records).collect()}
    assert got == {"<a>": (True, True, False), "<b>": (False, False, True), "<c>": (True, False, False)}


def test_parse_plain_and_gzip():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 12\r\n\r\nH: x\r\n\r\nbody\r\n\r\n"
    for data in (one * 2, gzip.compress(one) + gzip.compress(one)):
        got = list(A.parse_records(data))
        assert [r["payload"] for r in got] == ["body", "body"]


def test_empty(spark):
    assert A.capture_digest(A.archive_pages(pages(spark, []))).count() == 0
