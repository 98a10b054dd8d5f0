"""WARC archives against the pages they hold, plain gzip reading, and damaged archives."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter
from pathlib import Path

from pvgrid.llm.warc import EMPTY, make_record, pack, page_record, page_records, read_archive, read_archives, write_archives

PAGES = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(12)
    body = ["".join(rng.choice("abcé <>\r\n") for _ in range(rng.choice([0, 10, 900, 1200, 5000]))) for _ in range(40)]
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(body)]
    rows += [(100 + i, f"http://c/{i}", body[7] + "y" * 1000) for i in range(9)]          # copies
    rows += [(200 + i, "http://s/", "short copy") for i in range(5)]
    rows += [(300, None, "x" * 999), (301, None, "x" * 999), (302, None, "x" * 1000), (303, None, "x" * 1000), (304, "", "é" * 500)]
    rows += [(None, "http://n/", "z" * 1500), (None, "http://n/", "z" * 1500), (None, None, None), (400, "a b\r\nX: y\t", "z" * 1500)]
    rows += [(500, "u", "w" * 2000)] * 3                                                   # repeated rows
    rows += [(None, None, "v" * 2000)] * 2
    rows += [(600, "http://long/", "".join(rng.choice("0123456789abcdef") for _ in range(1 << 16)) * 300)]  # above 16 MiB
    rows += [(601, "http://fake/", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "\x1f\x08" * 600)]
    return rows


def wanted(rows):
    best = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            best[raw] = max(best.get(raw, (-1,)), (-1 if page_id is None else page_id,))
    out, given = [], set()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        keep = best.get(raw)
        first = keep is None or (keep[0] == (-1 if page_id is None else page_id) and raw not in given)
        if keep is not None and first:
            given.add(raw)
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit",
                    None if first or keep[0] < 0 else keep[0]))
    return out


def test_round_trip_matches_the_pages(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 AS id", "'k' AS key", "2 AS row", "3 AS n", "'b' AS body", "0 AS archive")
    got = page_records(df.repartition(3), str(tmp_path / "w"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(wanted(pages()))


def test_payloads_come_back_and_files_are_plain_gzip(spark, tmp_path):
    path = tmp_path / "w"
    write_archives(spark.createDataFrame(pages(), PAGES), str(path), max_bytes=20000)
    got = [r for r in read_archives(spark, str(path)).collect() if r.record_type == "response"]
    texts = {(h or "").encode() for _, _, h in pages()}
    assert {bytes(r.payload) for r in got} == texts and all(r.verified and r.error is None for r in got)
    assert {r.target_uri for r in got} >= {"a%20b%0D%0AX:%20y%09", None}
    files = sorted(path.rglob("part-*"))
    assert len(files) > 3
    for file in files:
        raw = file.read_bytes()
        text = gzip.decompress(raw)  # a reader of its own
        assert text.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
        here = sorted((r for r in read_archives(spark, str(file)).collect()), key=lambda r: r.offset)
        assert sum(r.length for r in here) + len(EMPTY) * sum(r.payload_bytes > 1 << 24 for r in here) == len(raw)


def test_revisits_refer_to_a_record_with_their_digest(spark, tmp_path):
    write_archives(spark.createDataFrame(pages(), PAGES), str(tmp_path / "w"))
    rows = read_archives(spark, str(tmp_path / "w")).collect()
    by_id = {r.record_id: r for r in rows}
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert len(by_id) == len(rows) and len(revisits) == 14
    for r in revisits:
        whole = by_id[r.refers_to]
        assert whole.record_type == "response" and r.payload is None
        assert (whole.payload_digest, whole.payload_bytes) == (r.payload_digest, r.payload_bytes)


def test_empty_table_gives_no_records(spark, tmp_path):
    assert page_records(spark.createDataFrame([], PAGES), str(tmp_path / "w")).collect() == []


def records(n=5):
    return [page_record(i, i, f"http://x/{i}", bytes([65 + i]) * 3000, "2020-01-01T00:00:00Z", None) for i in range(n)]


def read(data):
    return [(r[2], r[-2], r[-1]) for r in read_archive(memoryview(data))]


def test_damaged_archives():
    packed = [pack(r) for r in records()]
    good = ("response", True, None)
    assert read(b"".join(packed)) == [good] * 5
    assert read(b"") == [] and read(EMPTY) == []
    assert read(packed[0] + EMPTY + packed[1]) == [good] * 2
    assert read(packed[0][:-9]) == [(None, False, "cut off")]
    assert read(packed[0] + b"garbage" * 9 + packed[1]) == [good, (None, False, "does not unpack"), good]
    broken = bytearray(packed[1])
    broken[25] ^= 0xFF
    assert [r for r in read(packed[0] + bytes(broken) + packed[2]) if r[0]] == [good, good]
    assert read(pack(b"hello\r\n\r\n") + packed[0]) == [(None, False, "no record"), good]
    assert read(pack(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n\r\n\r\n")) == [(None, False, "no length")]
    assert read(pack(records()[0] + records()[1])) == [(None, False, "longer than its length says")]
    assert read(pack(records()[0][:-50])) == [(None, False, "shorter than its length says")]
    assert read(pack(b"WARC/1.0\r\n")) == [(None, False, "header without end")]
    assert read(pack(records()[0].replace(b"A" * 3000, b"A" * 2999 + b"B"))) == [("response", False, None)]


def test_records_of_other_writers():
    hexed = make_record("resource", "urn:a", "2020-01-01T00:00:00Z", b"plain block", "text/plain",
                        Payload_Digest="sha1:" + hashlib.sha1(b"plain block").hexdigest().upper())
    lower = hexed.replace(b"WARC-Type", b"warc-type").replace(b"Content-Length: ", b"content-length:")
    for record in (hexed, lower):
        (found,) = read_archive(memoryview(pack(record)))
        assert found[2] == "resource" and found[6] == b"plain block" and found[7] == 11 and found[9]
    # a payload that holds a packed archive doesn't confuse the reader
    inner = b"".join(pack(r) for r in records(2))
    outer = make_record("resource", "urn:b", "2020-01-01T00:00:00Z", inner, "application/gzip")
    assert [r[6] for r in read_archive(memoryview(pack(outer) + pack(hexed)))] == [inner, b"plain block"]
