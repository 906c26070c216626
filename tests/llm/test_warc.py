"""Operator 11: archives against the pages they were made of."""

import gzip
import hashlib

import oracle
import pytest
from cases import LONG

from trackweave.llm import warc
from trackweave.llm.common import new_path

BIG = "<p>é</p>" * 200
ROWS = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (9, "http://a/ 9\r\nX: y", BIG),
    (3, "http://b", "short"),
    (4, "http://c", "short"),
    (5, None, None),
    (6, "http://d", ""),
    (7, "http://e", LONG),
    (8, "http://f", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
    (None, "http://g", BIG),
    (None, "http://h", "x" * 2000),
    (None, "http://h", "x" * 2000),
    (9, "http://a/9", BIG),
    (2, "http://a/2", BIG),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, u, h, "k", "v", "d") for k, u, h in rows], "page_id bigint, url string, html string, key string, value string, digest string")


def brute(rows):
    most = {}
    for k, _, h in rows:
        if k is not None:
            most[h or ""] = max(most.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        first = most.get(h or "") if len(data) >= 1000 else None
        again = first is not None and first != k
        out.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def stored(spark, rows):
    path = new_path(spark, "warc")
    warc.write_archives(frame(spark, rows), path)
    return path


def test_odd_rows(spark):
    back = warc.read_archives(spark, stored(spark, ROWS))
    got = [(r.key and int(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in back.collect()]
    assert sorted(got, key=str) == brute(ROWS)
    assert warc.read_archives(spark, stored(spark, [])).collect() == []


def test_payloads_come_back(spark):
    back = warc.resolved(warc.read_archives(spark, stored(spark, ROWS), payload=True)).collect()
    assert sorted((str(r.key), bytes(r.payload)) for r in back) == sorted((str(k), (h or "").encode()) for k, _, h in ROWS)


def test_a_revisit_without_its_response_stays(spark):
    records = warc.read_archives(spark, stored(spark, ROWS), payload=True).filter("not (key <=> '9')")
    lost = warc.resolved(records).filter("record_type = 'revisit'").collect()
    assert len(lost) == 4 and all(r.payload is None and r.refers_to == "9" for r in lost)


def test_most_rows_are_one_payload(spark):
    rows = [(i, f"http://a/{i}", BIG if i % 3 else f"{i} " * 400) for i in range(3000)]
    back = warc.read_archives(spark, stored(spark, rows)).collect()
    assert sorted(((int(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in back), key=str) == brute(rows)


def test_the_files_are_archives(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(frame(spark, ROWS), path)
    records = [x for f in (tmp_path / "w").glob("part-*") for x in warc.parsed(gzip.decompress(f.read_bytes()))]
    assert len(records) == len(ROWS)
    for fields, block in records:
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(fields) and "x" not in fields
        assert block.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["warc-type"] == "revisit":
            assert fields["warc-refers-to"] == "<urn:x-record:9>" and fields["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")


def test_other_archives(spark, tmp_path):
    """Base32 digests, records of other kinds, no compression; damage is an error."""
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nhello"
    import base64

    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(info + head + body + b"\r\n\r\n")
    got = sorted(warc.read_archives(spark, f"file://{tmp_path}", payload=True).collect(), key=lambda r: r.record_type)
    assert [(r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in got] == [("response", 5, b"hello"), ("warcinfo", None, None)]
    for bad in (info[:-3], b"junk", (head + body + b"\r\n\r\n").replace(b"hello", b"jello")):
        with pytest.raises(ValueError):
            rows = list(warc.parsed(bad))
            for fields, block in rows:
                if warc._hex(fields.get("warc-payload-digest")) not in (None, hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest()):
                    raise ValueError


def test_the_sql_gives_the_same_rows(spark, sf_dir):
    assert oracle.differences(warc.query(spark, sf_dir), oracle.connect(sf_dir), warc.ORACLE) == ""
