import hashlib
import json

import pytest

from lexiloom.llm import warc

SCHEMA = "id long, url string, payload string, archive string"


def rows():
    big = "é" * 80
    out = [(k, f"http://h/{k}", "p" * (k % 120) + "x", None) for k in range(150)]
    return out + [(500, "u", big, None), (499, None, big, None), (501, "a b\r\nc", big, None), (502, "u", None, None), (503, "u", "", None), (504, "u", "s" * 99, None), (505, "u", "s" * 99, None), (506, "u", "WARC/1.1\r\n\r\n" * 40, None), (507, "u", "l" * 3_000_000, None)]


def test_round_trip(spark):
    data = rows()
    out = {r["page_id"]: r for r in warc.archive_and_read(spark, spark.createDataFrame(data, SCHEMA), most=4000).collect()}
    assert len(out) == len(data)
    first = {}
    for i, _, p, _ in sorted(data, key=lambda r: r[0]):
        first.setdefault(p or "", i)
    for i, _, p, _ in data:
        raw = (p or "").encode()
        again = len(raw) >= 100 and first[p] != i
        assert tuple(out[i]) == (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[p] if again else None)


def test_odd_ids(spark):
    big = "b" * 200
    data = [(3, "u", big, ""), (3, "u", big, ""), (None, "u", big, ""), (None, "u", "c" * 200, ""), (None, "u", "c" * 200, "")]
    out = sorted((r["record_type"], r["page_id"] or -1, r["refers_to"] or -1) for r in warc.archive_and_read(spark, spark.createDataFrame(data, SCHEMA)).collect())
    assert out == [("response", -1, -1), ("response", -1, -1), ("response", 3, -1), ("revisit", -1, 3), ("revisit", 3, 3)]
    assert warc.archive_and_read(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_stand_alone_and_cuts_are_seen(tmp_path):
    import gzip

    records = [warc._record("response", str(k), "http://u", hashlib.sha256(b"z" * k).hexdigest(), k, b"z" * k) for k in (0, 5, 200_000)]
    source, target = f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/b.warc.gz"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    assert warc.normalise(source, target, {2: 1})["records"] == 3
    entries = [json.loads(x) for x in (tmp_path / "b.warc.gz.idx").read_text().splitlines()]
    blob = (tmp_path / "b.warc.gz").read_bytes()
    for e in entries:
        assert gzip.decompress(blob[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
    assert [e["type"] for e in entries] == ["response", "response", "revisit"] and sum(e["length"] for e in entries) == len(blob)
    # Files of many members inflate as well, and a record that is cut off raises.
    assert warc.normalise(target, f"file://{tmp_path}/c.warc.gz")["records"] == 3
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b"".join(records)[:-50]))
    with pytest.raises(ValueError):
        warc.normalise(f"file://{tmp_path}/d.warc.gz", f"file://{tmp_path}/e.warc.gz")


def foreign(kind, block, *more, version="WARC/1.0"):
    head = "\r\n".join([version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "WARC-Date: 2021-03-04T05:06:07Z", *more, f"Content-Length: {len(block)}"])
    return head.encode(), block


def test_archives_of_others(tmp_path):
    import gzip

    http = "Content-Type: application/http; msgtype=response"
    plain = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>no length</p>"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    false = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\nnot in chunks"
    made = [
        foreign("warcinfo", b"software: other\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://h/"),
        foreign("response", plain, http, "WARC-Target-URI: http://h/", "WARC-Payload-Digest: sha1:ABCDEFGH"),
        foreign("response", chunked, http, "Warc-target-uri: http://h/c", "X-Folded: one", " two"),
        foreign("response", false, http),
        foreign("metadata", b"", "Content-Type: application/warc-fields"),
        foreign("resource", b"\r\n\r\nWARC/1.0\r\n", "WARC-Target-URI: file:///x"),
        foreign("response", b"1 2", "Content-Type: text/dns"),
    ]
    stream = b"".join(h + b"\r\n\r\n" + b + b"\r\n\r\n" for h, b in made)
    (tmp_path / "a.gz").write_bytes(gzip.compress(stream[:-4]))  # the last closing lines are missing
    target = f"file://{tmp_path}/b.gz"
    assert warc.normalise(f"file://{tmp_path}/a.gz", target, {3: 77})["records"] == len(made)
    index = warc.entries(target)
    with open(tmp_path / "b.gz", "rb") as f:
        back = [warc.read_member(f, e) for e in index]
    for k, (head, block) in enumerate(made):
        if k != 3:
            assert (back[k]["head"], back[k]["block"]) == (head, block)
    assert [b["payload"] for b in back] == [None, None, b"<p>no length</p>", None, b"not in chunks", None, made[6][1], b"1 2"]
    turned = back[3]
    assert turned["type"] == "revisit" and turned["refers_to"] == "urn:x-row:77" and turned["bytes"] == 11 and turned["digest"] == hashlib.sha256(b"hello world").hexdigest()
    assert turned["fields"]["x-folded"] == "one two" and turned["date"] == "2021-03-04T05:06:07Z" and turned["block"].endswith(b"chunked\r\n\r\n")
    assert [b["uri"] for b in back][1:4] == ["http://h/", "http://h/", "http://h/c"]


def test_archives_close_by_records(spark):
    data = [(k, None, None, "") for k in range(25)]
    out = warc.archive_and_read(spark, spark.createDataFrame(data, SCHEMA).coalesce(1), records_most=4)
    assert sorted(r["page_id"] for r in out.collect()) == list(range(25))
