"""Archives: round trips, the files' form by an independent reader, revisits, awkward rows."""

from __future__ import annotations

import glob
import hashlib
import os
import struct

import pytest
import zstandard

from framewright.llm import warc_store as ws
from framewright.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, digest string, payload int, data string, refers_to long"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "d", 1, "x", 5) for i, u, h in rows], SCHEMA).repartition(parts)


def html(k, n=40):
    return f"<html><head><title>page {k}</title></head><body>" + "".join(f"<p class='line'>row {k * j % 97} of the page</p>" for j in range(n)) + "</body></html>"


def brute(rows):
    out, least = [], {}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in data:
        if len(b) >= 100 and i is not None:
            least[b] = min(i, least.get(b, i))
    for i, b in data:
        first = least.get(b) if len(b) >= 100 else None
        same = first is None or i == first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if same else "revisit", None if same else first))
    return sorted(map(repr, out))


ODD = [(1, "http://a/1", html(1)), (2, "http://a/2", html(2)), (5, "http://a/5", html(1)), (3, None, html(1)), (4, "http://a/ü b\r\nX: y", None),
       (6, "", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", html(2)), (None, "u", html(9)), (2, "http://a/2", html(2)),
       (9, "u", "é猫😀" * 40_000), (10, "u", "x" * 100), (11, "v", "x" * 100), (12, "v", "y" * 99), (13, "v", "y" * 99), (14, "w", "a\r\n\r\nWARC/1.1\r\n\r\n" * 30)]


def test_every_row_comes_back_as_it_should(spark):
    got = ws.write_and_read(pages(spark, ODD))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(ODD)


def test_payloads_and_headers(spark):
    out = shared_path(spark, "archive-test")
    ws.write(pages(spark, ODD), out, date="2020-02-02T02:02:02Z")
    rows = ws.read(spark, out).collect()
    texts = {h or "" for _, _, h in ODD}
    assert {bytes(r["payload"]).decode() for r in rows if r["record_type"] == "response"} == texts
    assert all(r["payload"] is None for r in rows if r["record_type"] == "revisit")
    assert {r["url"] for r in rows if r["page_id"] == 4} == {"http://a/%C3%BC%20b%0D%0AX:%20y"} and {r["url"] for r in rows if r["page_id"] == 3} == {"about:blank"}
    assert len({r["record_id"] for r in rows}) == len(rows) - 1  # the page that is there twice
    refers = {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"}
    assert refers == {(5, 1), (3, 1), (None, 2), (11, 10)}


def test_the_files_are_plain_zstandard_with_a_leading_dictionary(spark):
    rows = [(i, f"http://a/{i}", html(i)) for i in range(400)]
    out = shared_path(spark, "archive-test")
    given = ws.write(pages(spark, rows, 2), out)
    assert len(given) > 1000
    files = [f for f in glob.glob(out.removeprefix("file:") + "/part-*") if os.path.getsize(f)]
    assert 0 < len(files) <= 2
    n = whole = 0
    for f in files:
        data = open(f, "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and data[8 : 8 + size] == given
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        plain = codec.stream_reader(data[8 + size :], read_across_frames=True).read()  # passes over the other skippable frames
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.endswith(b"\r\n\r\n")
        n, whole = n + plain.count(b"WARC-Type: response"), whole + len(data) - size
        dictionary, frames = ws.frames_of(data)
        assert dictionary == given and all(one.startswith(b"WARC/1.1\r\n") for one in frames) and b"".join(frames) == plain
    assert n == 400
    # the dictionary pays: the same records as frames without it take much more
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(ws.page_record(i, u, h.encode(), hashlib.sha256(h.encode()).hexdigest(), None, "d", ""))) for i, u, h in rows)
    assert whole < 0.7 * alone
    foreign = ws.read_files(spark, out + "/part-*")
    columns = ["page_id", "record_type", "payload_digest", "payload"]
    assert sorted(map(repr, foreign.select(*columns).collect())) == sorted(map(repr, ws.read(spark, out).select(*columns).collect()))


def test_a_large_file_is_read_by_several_tasks(spark):
    rows = [(i, None, os.urandom(3000).hex()) for i in range(1500)]
    out = shared_path(spark, "archive-test")
    ws.write(pages(spark, rows, 1), out)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = ws.read(spark, out)
        assert got.rdd.getNumPartitions() > 2 and {r["page_id"] for r in got.select("page_id").collect()} == set(range(1500))
        assert got.count() == 1500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ws.write_and_read(empty).count() == 0


def test_damage_is_noticed():
    digest = hashlib.sha256(b"hello").hexdigest()
    good = ws.page_record(1, "u", b"hello", digest, None, "d", "")
    assert ws.parsed(good)["payload"] == b"hello" and ws.parsed(ws.page_record(1, "u", b"hello", digest, 0, "d", ""))["payload_bytes"] == 5
    for bad in (good[:-3], good.replace(b"hello", b"hellO"), b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            ws.parsed(bad)
    codec = ws.Frames(b"", "0123456789abcdef")
    run = codec.run([codec.frame(good), codec.frame(good * 2)])
    assert [zstandard.ZstdDecompressor().decompress(f) for f in ws.split_run(run)[1]] == [good, good * 2]
    with pytest.raises(ValueError):
        ws.split_run(run[:-1])


def test_lengths_are_found_even_if_they_look_like_their_frame():
    magic = struct.pack("<I", ws.LENGTHS)
    frames = [b"a" * 5, magic + b"\x08\0\0\0" + b"b" * 8, b"c"]
    assert ws.split_run(ws.Frames.run(frames)) == (None, frames)


def test_a_record_with_the_mark_stops_the_write():
    codec = ws.Frames(b"", "0123456789abcdef")
    with pytest.raises(ValueError, match="mark"):
        codec.frame(codec.mark * 1)
