"""WARC archive: records against plain Python, exact round trips, refused damage."""

import glob
import hashlib

import pytest

from oracle import connect, difference
from reelgrid.llm import warc as wa

SMALL = "/root/testdata/sf0.001"
COLUMNS = "page_id long, url string, html string"
LONG = "x" * 120


def plain(pages):
    """Record rows; of equal rows the first is the response."""
    out, groups = [], {}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append(page_id)
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, page_id in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(),
                        "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def query(spark, folder, pages, columns=COLUMNS):
    spark.createDataFrame(pages, columns).write.parquet(f"{folder}/pages.parquet")
    return sorted(map(tuple, wa.op12_warc(spark, str(folder)).collect()), key=repr)


PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/2", LONG[:99]),
         (4, None, LONG[:99]), (5, "a\r\nb: c", ""), (6, "é", None), (2, "http://a/2", LONG),
         (7, "u", "ä" * 60), (0, "u", "ä" * 60), (None, "n", LONG), (None, None, None),
         (9, "u", "two\r\n\r\nWARC/1.1\r\nparts" * 9), (10, "u", "Y" * 3_000_000),
         (11, "v", "Y" * 3_000_000)] + [(k, "hot", "hot page " * 20) for k in range(100, 160)]


def test_records_of_odd_pages(spark, tmp_path):
    """Nulls, repeated rows, sizes about the least one, hot payloads, very long ones."""
    assert query(spark, tmp_path, PAGES) == plain(PAGES)


def test_only_null_ids_empty_table_and_clashing_columns(spark, tmp_path):
    same = [(None, "a", LONG), (None, "b", LONG)]
    assert query(spark, tmp_path / "a", same) == plain(same)
    assert query(spark, tmp_path / "b", []) == []
    wide = [(1, "u", LONG, "d", 3), (2, "u", LONG, "e", 4)]
    assert query(spark, tmp_path / "c", wide, COLUMNS + ", digest string, `row` int") == plain(
        [w[:3] for w in wide])


def parsed(data):
    """Records of WARC bytes by their Content-Length, in plain Python."""
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block, data = data[:size], data[size:]
        assert data[:4] == b"\r\n\r\n"
        data = data[4:]
        yield fields, block


def test_records_round_trip_through_files(spark, tmp_path):
    """Few rows a copy, so one payload is dealt several times; files give the payloads back."""
    archive = str(tmp_path / "archive")
    wa.write_archive(spark.createDataFrame(PAGES, COLUMNS), archive, copy_rows=7, salts=3)
    payloads = spark.read.parquet(f"{archive}/payloads")
    assert payloads.count() == len({(h or "") for _, _, h in PAGES})
    rows = wa.read_archive(spark, archive).collect()
    assert sorted((bytes(r.payload) for r in rows)) == sorted((h or "").encode() for _, _, h in PAGES)
    wa.write_warc_files(spark, archive, str(tmp_path / "files"))
    found = [x for f in glob.glob(str(tmp_path / "files" / "part-*"))
             for x in parsed(open(f, "rb").read())]
    assert len(found) == len(PAGES) == len({f["WARC-Record-ID"] for f, _ in found})
    by_id = {f["WARC-Record-ID"]: (f, block) for f, block in found}
    seen = []
    for fields, block in found:
        head, payload = block.split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "revisit":
            assert payload == b""
            payload = by_id[fields["WARC-Refers-To"]][1].split(b"\r\n\r\n", 1)[1]
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert f"Content-Length: {len(payload)}".encode() in head
        seen.append((fields.get("WARC-Target-URI"), payload))
    urls = {"a\r\nb: c": "a%0D%0Ab: c"}
    assert sorted(seen, key=repr) == sorted(
        [(urls.get(u, u), (h or "").encode()) for _, u, h in PAGES], key=repr)


def test_damage_stops_the_read(spark, tmp_path):
    archive = str(tmp_path / "archive")
    wa.write_archive(spark.createDataFrame(PAGES[:3], COLUMNS), archive)
    bad = spark.read.parquet(f"{archive}/payloads").collect()
    bad = [(r.digest, bytes(r.payload) + b"!", r.payload_bytes, 1) for r in bad]
    spark.createDataFrame(bad, "digest string, payload binary, payload_bytes long, copies int").write.mode(
        "overwrite").parquet(f"{archive}/payloads")
    with pytest.raises(Exception, match="not that of its digest"):
        wa.read_archive(spark, archive).collect()
    spark.createDataFrame([], "digest string, payload binary, payload_bytes long, copies int").write.mode(
        "overwrite").parquet(f"{archive}/payloads")
    with pytest.raises(Exception, match="no payload for the digest"):
        wa.read_archive(spark, archive).collect()


def test_query_against_sql(spark):
    assert difference(wa.op12_warc(spark, SMALL), connect(SMALL), wa.OP12_SQL) is None
