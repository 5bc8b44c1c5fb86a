"""WARC archives: round trips, revisits, damage, odd rows."""

import gzip
import hashlib
import io

import pytest

from quillspark.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, `a.b` string, KEY long"


def pages():
    long, other = "<p>é repeated</p>" * 100, "x" * 999
    rows = [(i, f"http://example.org/{i}", long) for i in (3, 9, 4)] + [(1, None, None), (2, "u\r\nWARC-Type: forged", ""), (5, "http://s", other), (6, "http://s", other), (7, "u", "y" * 1000), (8, "u", "y" * 1000)]
    rows += [(10, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60), (None, "n", long), (None, None, "short"), (9, "again", long), (9, "again", long), (11, "m", "megabyte " * 300_000)]
    return [(*r, "clash", "dot", 1) for r in rows]


def expected(rows):
    top: dict = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, -1), -1 if i is None else i)
    out = []
    for i, _, html, *_ in rows:
        raw, first = (html or "").encode(), top.get(html)
        revisit = first is not None and first >= 0 and i != first
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows, path = pages(), str(tmp_path / "w")
    warc.write(warc.page_records(spark.createDataFrame(rows, SCHEMA).repartition(3)), path, most_bytes=300)
    for payloads in (True, False):
        assert sorted(map(tuple, warc.page_report(warc.read(spark, path, payloads)).collect()), key=str) == expected(rows)
    read = warc.read(spark, path)
    held = [(r["fields"].get("X-Row-Key"), bytes(r["payload"])) for r in read.where("record_type = 'response'").collect()]
    for i, _, html, *_ in rows:
        if i in (7, 8, 9, 10, 11):
            assert i == 7 or (str(i), html.encode()) in held
    assert sorted(r["target_uri"] for r in read.where("fields['X-Row-Key'] = '2'").collect()) == ["u%0D%0AWARC-Type: forged"]
    back = warc.revisited(read).collect()
    assert len(back) == 4 and all(r["found"] and len(r["payload"]) >= 1000 for r in back)
    files = list((tmp_path / "w").iterdir())
    assert len(files) > 3 and all(f.name.endswith(warc.SUFFIX) for f in files)  # small archives, nothing left of the tasks
    for f in files:
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\nWARC-Type") >= 2
    for r in read.where("record_type = 'response'").collect():  # one member a record, at the place that is said
        with open(tmp_path / "w" / r["archive"], "rb") as f:
            f.seek(r["offset"])
            assert gzip.decompress(f.read(r["size"])).endswith(bytes(r["payload"]) + b"\r\n\r\n")
    warc.write(warc.page_records(spark.createDataFrame(rows[:1], SCHEMA)), path)
    assert warc.read(spark, path).where("record_type <> 'warcinfo'").count() == 1


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(warc.page_records(spark.createDataFrame([], SCHEMA)), path)
    assert warc.page_report(warc.read(spark, path)).count() == 0


def member(block=b"some text", **change):
    fields = {"WARC-Type": "resource", "WARC-Record-ID": "<a>", "Content-Type": "text/plain", "Content-Length": str(len(block))} | change
    return gzip.compress(b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + b"\r\n" + block + b"\r\n\r\n")


def test_reads_what_others_write():
    sha = hashlib.sha1(b"some text").hexdigest()
    raw = member() + member(**{"WARC-Block-Digest": f"sha1:{sha}", "X-Folded": "one\r\n two"}) + member(**{"WARC-Payload-Digest": "sha1:" + "A" * 32})
    got = list(warc.read_archive(io.BytesIO(raw)))
    assert [r["verified"] for r in got] == [True, True, False] and {r["payload"] for r in got} == {b"some text"}
    assert dict(got[1]["fields"]) == {"X-Folded": "one two"} and [r["payload_digest"] for r in got[:2]] == [sha, sha]
    assert [raw[r["offset"] : r["offset"] + r["size"]][:2] for r in got] == [b"\x1f\x8b"] * 3


@pytest.mark.parametrize("raw", [member()[:-9], member(**{"Content-Length": "8"}), member(**{"Content-Length": "10"}), gzip.compress(b"no record"), gzip.compress(b"HTTP/1.1\r\n\r\n")])
def test_broken_framing_is_an_error(raw):
    with pytest.raises(ValueError, match="record|header|archive"):
        list(warc.read_archive(io.BytesIO(raw)))
