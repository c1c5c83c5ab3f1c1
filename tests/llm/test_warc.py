"""Archives written and read back, with records inside payloads, against what went in."""

import base64
import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import warc
from tallyframe.llm.warc import candidates, parse_head, read_warc, record_bytes, warc_files, with_revisited, write_warc

SCHEMA = "page_id long, url string, html string, payload string, sha string, `group` string, first int, copy int, row int, n int, of int, at int"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 999\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    """Every row's record, as a sorted list; of rows that share the smallest page_id one is the response."""
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        size = len(html.encode())
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, page_id in enumerate(ids):
            copy = n > 0 and size >= min_bytes
            out.append((page_id, size, digest(html), "revisit" if copy else "response", ids[0] if copy else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


def seen(records):
    pages = records.where("record_type != 'warcinfo'")
    return sorted((tuple(r) for r in pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    html = lambda: rng.choice(["", FAKE, "WARC/1.0\r\n", "\r\n\r\n", "<p>é", "\x1f\x8b\x08"]) * rng.randint(0, 4) + str(rng.random()) * rng.randint(0, 90)
    rows = [(i, f"https://h{i % 7}.org/{i}", html()) for i in range(150)]
    rows += [(200 + i, "https://copies.org/", FAKE * 40) for i in range(120)]  # a hot group of copies, full of records
    rows += [(400, None, None), (401, "bad\r\nX-Page-Id: 7\r\n\r\n", ""), (402, "u", "tiny"), (403, "u", "tiny"), (404, "ü ", "漢" * 400_000)]
    rows += [(405, "u", "WARC/1.1\r\nContent-Length: 5\r\n" * 3000), (406, "u", (FAKE * 3)[:-4])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("packed, split_bytes, file_bytes", [(True, 1 << 23, 1 << 30), (True, 700, 9000), (False, 1 << 23, 1 << 30), (False, 333, 9000)])
def test_pages_come_back(spark, pages, packed, split_bytes, file_bytes):
    if split_bytes < 1000:
        pages = [p for p in pages if len(p[2] or "") < 100_000]
    manifest = write_warc(frame(spark, pages).repartition(3), packed=packed, file_bytes=file_bytes)
    assert seen(read_warc(manifest, split_bytes)) == expected(pages)
    assert manifest.agg({"records": "sum"}).first()[0] == len(pages)
    listed = warc_files(spark, manifest.first()["folder"])
    assert sorted(map(tuple, listed.select("file", "bytes").collect())) == sorted(map(tuple, manifest.select("file", "bytes").collect()))


def test_payloads_and_revisits(spark, pages):
    records = with_revisited(read_warc(write_warc(frame(spark, pages), min_bytes=5), 5000))
    got = {r.page_id: bytes(r.payload) for r in records.where("record_type != 'warcinfo'").collect()}
    assert got == {p: (h or "").encode() for p, _, h in pages}
    assert seen(records) == expected(pages, 5)
    uris = {r.page_id: r.target_uri for r in records.collect()}
    assert uris[401] == "bad%0D%0AX-Page-Id:%207%0D%0A%0D%0A" and uris[400] is None and uris[0] == "https://h0.org/0"


def test_repeated_and_null_ids(spark):
    rows = [(1, "a", "x")] * 3 + [(2, "b", "x"), (None, None, "x"), (None, "n", None), (None, None, None), (3, "c", "y"), (3, "c", "z"), (3, "c", "z")]
    assert seen(read_warc(write_warc(frame(spark, rows)))) == expected(rows)


def test_no_pages(spark):
    manifest = write_warc(frame(spark, []))
    assert manifest.count() == 0 and read_warc(manifest).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_other_archives_and_broken_ones(spark, tmp_path, packed):
    records = [record_bytes([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], b"block %d " % i * i, packed) for i in range(40)]
    name = "other.warc" + ".gz" * packed
    (tmp_path / name).write_bytes(b"".join(records))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = read_warc(warc_files(spark, str(tmp_path)), 100).orderBy("at").collect()
    assert [(r.record_id, bytes(r.payload), r.page_id) for r in got] == [(f"<{i}>", b"block %d " % i * i, None) for i in range(40)]
    (tmp_path / name).write_bytes(b"".join(records)[:-30])
    with pytest.raises(ValueError, match="breaks off"):
        read_warc(warc_files(spark, str(tmp_path)), 100)
    whole = b"".join(records)
    (tmp_path / name).write_bytes(whole[: len(whole) // 2] + b"?" + whole[len(whole) // 2 :])
    with pytest.raises(ValueError, match="breaks off"):
        read_warc(warc_files(spark, str(tmp_path)), 100)


def test_wrong_digest_is_an_error(spark, tmp_path):
    fields = [("WARC-Type", "response"), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)]
    (tmp_path / "a.warc").write_bytes(record_bytes(fields, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", False))
    with pytest.raises(Exception, match="not that of its digest"):
        read_warc(warc_files(spark, str(tmp_path))).collect()


@given(st.lists(st.sampled_from([FAKE, "WARC/1.1\r\n", "x: y\r\n", "Content-Length: 0\r\n\r\n\r\n\r\n", "abc"]), max_size=12), st.integers(1, 80), st.booleans())
@settings(max_examples=120, deadline=None)
def test_chains_from_the_start_are_the_records(pieces, split, packed):
    payload = "".join(pieces).encode()
    parts = [record_bytes([("WARC-Type", "resource")], b, packed) for b in (payload, b"", payload * 2)]
    data = b"".join(parts)
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    found = {at: (after, leaves, begin) for begin in range(0, len(data), split) for at, after, leaves in candidates(file, begin, min(begin + split, len(data)), len(data))}
    at, starts = 0, []
    while at < len(data):
        starts.append(at)
        at = found[at][0]
    assert starts == [0, len(parts[0]), len(parts[0]) + len(parts[1])] and at == len(data)
    for at, (after, leaves, begin) in found.items():
        end = begin + split
        while after < end and after in found and found[after][2] == begin:
            after = found[after][0]
        assert leaves == (after if after >= min(end, len(data)) else None)


def test_heads():
    head = lambda data: parse_head(lambda n: data[:n], len(data))
    assert head(b"WARC/1.0\r\nA: b\r\n c\r\nContent-Length: 12\r\n\r\n").fields == {"a": "b c", "content-length": "12"}
    assert head(b"WARC/1.0\r\nA: " + b"x" * 300_000 + b"\r\n\r\nrest").size == 300_017
    assert head(b"WARC/1.0\r\nno field\r\n\r\n") is None and head(b"WARC/1.0\r\nA: b\r\n") is None and head(b"") is None
    assert head(b"WARC/1.0x\r\n\r\n") is None and head(b"WARC/1.0\r\nContent-Length: -1\r\n\r\n").length is None


def test_members_are_gzip(spark, pages):
    manifest = write_warc(frame(spark, pages[:20]))
    row = manifest.first()
    with open(f"{row['folder']}/{row['file']}", "rb") as file:
        assert gzip.decompress(file.read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_registered_query(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = contract.queries()["op11_warc"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert warc.SPLIT_BYTES > 1 << 20
