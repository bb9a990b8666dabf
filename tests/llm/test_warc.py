import gzip
import hashlib
import io

import pytest

from offerlens.llm import common, warc
from offerlens.llm.queries import op3_warc_round_trip


def pages_of(spark, rows):
    return spark.createDataFrame([(p, u, h, "clash") for p, u, h in rows], "page_id long, url string, html string, payload string")


def brute(rows):
    keeper = {}
    for p, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", float("-inf")), float("-inf") if p is None else p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and keeper[h or ""] != (float("-inf") if p is None else p)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keeper[h or ""] if again else None))
    return sorted(out, key=str)


BIG, WIDE = "<p>big</p>" * 200, "é日\r\n\r\nWARC/1.1\r\n" * 300
ROWS = [(i, f"http://h/{i}", BIG) for i in range(40)] + [(100, None, None), (101, "", ""), (102, "http://x\r\nEvil: 1", "small"), (103, "u", "small"), (104, "u", WIDE), (99, "u", WIDE), (None, "u", BIG), (105, "u", "z" * 3_000_000), (106, "u", "y" * 999), (107, "u", "y" * 999), (108, "u", "y" * 1000), (109, "u", "y" * 1000)]


def test_round_trip(spark):
    rows = warc.round_trip(pages_of(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, rows), key=str) == brute(ROWS)


def test_payloads_come_back_and_files_are_plain_warc(spark):
    folder = common.shared_path(spark, "warc-test")
    manifest = warc.write_archives(warc.plan_records(pages_of(spark, ROWS)), folder, archive_bytes=2000)
    assert manifest.count() > 1
    html = {p: (h or "").encode() for p, _, h in ROWS}
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[r["page_id"]]
    path = manifest.first()["path"]
    with gzip.open(path) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: re")


def test_query(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, op3_warc_round_trip(spark, sf).collect()), key=str) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert warc.round_trip(pages_of(spark, [])).collect() == []
    twice = [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG)]
    assert sorted(map(tuple, warc.round_trip(pages_of(spark, twice)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(twice)


def test_members_are_inflated_in_any_blocks():
    records = [warc.make_record(i, "u", (f"page {i} " * i).encode(), None, False, "2000-01-01T00:00:00Z") for i in range(50)]
    data = b"".join(records)
    for block in (1, 7, 1000, 1 << 20):
        got = [warc.read_record(m) for m in warc.members(io.BytesIO(data), block)]
        assert [g["payload"] for g in got] == [(f"page {i} " * i).encode() for i in range(50)]
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(data[:-5])))
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(b"not gzip at all")))


def test_broken_records_are_refused():
    good = gzip.decompress(warc.make_record(1, "u", b"payload", None, False, "2000-01-01T00:00:00Z"))
    assert warc.read_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good + b"x", good.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"), good.replace(b"Content-Length: 9", b"Content-Length: 8"), b"HTTP/1.1 200 OK\r\n\r\n", good.replace(b"sha1:", b"md99:", 1)):
        if bad != good:
            with pytest.raises(warc.BadRecord):
                warc.read_record(bad)
    folded = good.replace(b"WARC-Target-URI: u", b"WARC-Target-URI: u\r\n more")
    assert warc.read_record(folded)["fields"]["warc-target-uri"] == "u more"


def test_record_ids_and_references(spark, tmp_path):
    """Rows that share a page_id have records of their own; a revisit names the record that stores its payload."""
    rows = [(1, "u", "small"), (1, "u", "small"), (1, "v", "other"), (2, "u", BIG), (9, "u", BIG), (None, "u", BIG), (9, "w", WIDE), (3, "u", WIDE), (None, None, None), (None, "", "")]
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(warc.plan_records(pages_of(spark, rows)), folder)
    fields = []
    for r in manifest.collect():
        with open(r["path"], "rb") as f:
            fields += [warc.read_record(m)["fields"] for m in warc.members(f)]
    ids = [f["warc-record-id"] for f in fields]
    assert len(ids) == len(set(ids)) == len(rows)
    stored = {f["warc-record-id"]: f for f in fields if f["warc-type"] == "response"}
    again = [f for f in fields if f["warc-type"] == "revisit"]
    assert len(again) == 3 and all(stored[f["warc-refers-to"]]["warc-payload-digest"] == f["warc-payload-digest"] for f in again)
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.read_archives(manifest, folder).collect() if r["record_type"] == "revisit" and r["page_id"]) == [(2, 9), (3, 9)]
