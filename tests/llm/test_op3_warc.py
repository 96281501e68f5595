"""Archives: exact round trips, the seek table, and access by record identifier."""

import base64
import hashlib
import re
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.llm import warc
from weftline.llm.common import materialise

SCHEMA = "page_id long, url string, html string, sha string, first long"


def pages(spark, prose):
    rows = [(i, f"http://e.org/{i}", f"<p>{prose(50 + i, i % 40)}</p>", "x", 1) for i in range(120)]
    rows += [(200, None, "", "x", 1), (199, "http://a b\r\nc", None, "x", 1), (None, "u", "<p>none</p>", "x", 1), (300, "é", "<p>" + "long é𝄞 " * 200_000, "x", 1), (7, "again", rows[7][2], "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(rows):
    out = []
    for page, _, html, *_ in rows:
        equal = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        payload = (html or "").encode()
        first = min(equal, default=None)
        revisit = page != first and first is not None
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, prose):
    df = pages(spark, prose)
    archives = materialise(warc.bundles(df.repartition(3)), "test-warc")
    got = sorted((tuple(r)[:5] for r in warc.read(archives).collect()), key=str)
    assert got == expected([tuple(r) for r in df.collect()])


def test_small_payloads_are_all_responses(spark, prose):
    df = pages(spark, prose)
    found = warc.read(warc.bundles(df, least=10**9))
    assert {r["record_type"] for r in found.collect()} == {"response"}


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, prose, monkeypatch):
    archives = warc.bundles(pages(spark, prose).repartition(2)).collect()
    for row in archives:
        data = bytes(row["data"])
        table = warc.seek_table(data)
        plain = b"".join(warc.frame(data, k) for k in range(len(table)))
        out, reader = b"", zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        while piece := reader.read(1 << 20):
            out += piece
        assert out == plain and sum(x[2] for x in table) == len(plain)
        assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
        assert sum(x[1] for x in table) + 8 + 8 * len(table) + 9 == len(data)
        assert all(x[2] <= warc.FRAME_BYTES for x in table[:-1]) or any(x[2] > 1e6 for x in table)
        records = list(warc.parse(plain))
        assert len(records) == len(row["records"]) and records[0][2]["WARC-Type"] == "warcinfo"


def test_every_record_is_found_by_its_identifier(spark, prose):
    df = pages(spark, prose).filter("page_id is not null")
    archives = materialise(warc.bundles(df), "test-warc")
    index = warc.index(archives)
    assert index.count() == df.count() + archives.count()
    ids = index.select("record_id").filter(F.col("record_id").isin("<urn:x-page:3>", "<urn:x-page:43>", "<urn:x-page:300>"))
    got = {r["record_id"]: bytes(r["record"]) for r in warc.fetch(archives, ids).collect()}
    html = {r["page_id"]: r["html"] for r in df.collect()}
    assert got.keys() == {"<urn:x-page:3>", "<urn:x-page:43>", "<urn:x-page:300>"}
    for name in ("3", "300"):
        _, _, head, block = next(warc.parse(got[f"<urn:x-page:{name}>"]))
        assert head["WARC-Record-ID"] == f"<urn:x-page:{name}>" and block.partition(b"\r\n\r\n")[2].decode() == html[int(name)]
    (_, _, head, block), = warc.parse(got["<urn:x-page:300>"])
    assert int(head["Content-Length"]) == len(block)


def test_a_frame_is_decompressed_once(spark, prose, monkeypatch):
    """For all records of a bundle, and not at all if none of its records is wanted."""
    rows = warc.bundles(pages(spark, prose)).collect()
    asked = []
    frame = warc.frame
    monkeypatch.setattr(warc, "frame", lambda data, k: asked.append(k) or frame(data, k))
    for row in rows:
        places = [r.asDict() for r in row["records"]]
        asked.clear()
        records = [(p["record_id"], x) for p, x in warc.records_at(bytes(row["data"]), places[::-1])]
        assert len(records) == len(places) and sorted(asked) == list(range(len(warc.seek_table(bytes(row["data"])))))
        assert all(f"WARC-Record-ID: {name}\r\n".encode() in x for name, x in records)
        asked.clear()
        assert len(list(warc.records_at(bytes(row["data"]), places[-1:]))) == 1 and len(asked) == 1


def test_an_index_of_another_bundle_is_an_error(spark, prose):
    archives = warc.bundles(pages(spark, prose))
    wrong = archives.withColumn("records", F.transform("records", lambda r: F.struct(F.concat(r["record_id"], F.lit("?")).alias("record_id"), r["frame"].alias("frame"), r["offset"].alias("offset"), r["length"].alias("length"))))
    with pytest.raises(Exception, match="another record"):
        warc.read(wrong).count()


def test_headers_keep_to_their_lines():
    name, data = warc.record(5, "http://a b\r\nX: y", b"<p>", None, "u")
    head = data.split(b"\r\n\r\n")[0].decode()
    assert "WARC-Target-URI: http://a%20b%0D%0AX:%20y" in head.split("\r\n") and name in head
    name, data = warc.record(None, None, b"", 4, "u")
    assert "<urn:x-page:none:u>" == name and b"WARC-Refers-To: <urn:x-page:4>" in data


def test_export_writes_files(spark, prose, tmp_path):
    archives = materialise(warc.bundles(pages(spark, prose)), "test-warc")
    paths = [r["path"] for r in warc.export(archives, f"file://{tmp_path}").collect()]
    assert paths and all(re.search(r"\.warc\.zst$", p) for p in paths)
    assert {p.name for p in tmp_path.iterdir()} == {p.rsplit("/", 1)[1] for p in paths}


def test_empty_table(spark, prose):
    none = pages(spark, prose).filter("false")
    assert warc.bundles(none).count() == 0 and warc.read(warc.bundles(none)).count() == 0
