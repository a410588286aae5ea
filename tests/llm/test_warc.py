import base64
import gzip
import hashlib
import json

from panelmc.llm import shared, warc

PAGES = "page_id long, url string, html string, digest string"


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = first.get(b, i) == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else first[b]))
    return sorted(out, key=str)


def rows_of():
    rows = [(i, f"http://h/{i} x\r\nWARC-Type: spoof", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n\r\n") for i in range(40)]
    return [*rows, (50, None, None), (51, "u", ""), (52, "http://é.x", "é" * 3_000_000), (53, "u", "é" * 3_000_000), (54, "u", "tiny"), (55, "u", "tiny")]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = rows_of()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    for least in (0, 5):
        got = warc.round_trip(pages, least, f"file://{tmp_path}/w{least}").collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows, least)
        html = {i: (h or "").encode() for i, _, h in rows}
        assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")


def test_members_and_sidecars_on_disk(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    pages = spark.createDataFrame([(*r, "") for r in rows_of()], PAGES).repartition(2)
    whole = warc.write_archives(warc.planned(pages), folder)
    index = warc.normalise(whole, folder).collect()
    assert sum(r.records for r in whole.collect()) == len(index) == len(rows_of())
    for path in {r.path for r in index}:
        data = open(path.removeprefix("file://"), "rb").read()
        side = [json.loads(x) for x in open(path.removeprefix("file://") + ".idx")]
        assert [(s["offset"], s["length"]) for s in side] == sorted((r.offset, r.length) for r in index if r.path == path)
        assert b"".join(gzip.decompress(data[s["offset"] : s["offset"] + s["length"]]) for s in side) == gzip.decompress(data)
        assert side[-1]["offset"] + side[-1]["length"] == len(data)


def test_no_pages_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.round_trip(none, 0, f"file://{tmp_path}/n").count() == 0
    same = spark.createDataFrame([(1, "u", "x", ""), (1, "u", "x", ""), (2, "u", "x", "")], PAGES)
    got = warc.round_trip(same, 0, f"file://{tmp_path}/s").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_hot_payloads_and_null_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    rows = [(i, f"u{i}", "same" if i % 3 else "other" if i % 2 else None) for i in range(30)] + [(31, "u", "own")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string").repartition(3)
    got = warc.round_trip(pages, 0, f"file://{tmp_path}/h").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    none = spark.createDataFrame([(None, "u", "x", ""), (4, "u", "x", ""), (None, None, "y", "")], PAGES)
    got = warc.round_trip(none, 0, f"file://{tmp_path}/i").collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == [(4, "response", None), (None, "response", None), (None, "revisit", 4)]
