import base64
import hashlib
import struct

import zstandard

from varlake.llm import warc
from varlake.llm.shared import scratch

PAGES = "page_id long, url string, html string, refers_to string, value int"


def pages(spark):
    shared = "<html>" + "the same page " * 50 + "</html>"
    rows = [(i, f"http://h/{i}", f"<html><p>page {i}</p>" + "<div>boiler plate</div>" * 40) for i in range(60)]
    rows += [(100, "u", shared), (99, "u", shared), (101, None, shared), (102, "u\r\nX: y", None), (103, "u", "")]
    rows += [(104, "ü", "\r\n\r\nContent-Length: 5\r\n\r\nä"), (105, "u", "x" * 500_000), (99, "u", shared), (None, "u", shared), (None, None, None)]
    return spark.createDataFrame([(*row, "clash", 1) for row in rows], PAGES).repartition(3)


def test_round_trip(spark):
    table = pages(spark)
    rows = table.collect()
    first = {}
    for row in rows:
        payload = (row["html"] or "").encode()
        if row["page_id"] is not None:
            first[payload] = min(first.get(payload, row["page_id"]), row["page_id"])
    expected = []
    for row in rows:
        payload = (row["html"] or "").encode()
        leader = first.get(payload)
        revisit = leader is not None and leader != row["page_id"]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected.append((row["page_id"], len(payload), digest, "revisit" if revisit else "response", leader if revisit else None))
    got = warc.archived(table).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    key = lambda row: tuple((value is None, value or 0) for value in row)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_short_payloads_are_responses(spark):
    got = warc.archived(pages(spark), least_bytes=10_000)
    assert got.where("record_type = 'revisit'").count() == 0
    assert got.where("html is null").count() == 0


def test_dictionary_leads_and_records_stand_alone(spark):
    path = scratch(spark, "warc-test")
    warc.write_archives(pages(spark), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    seen = 0
    for file in files:
        content = bytes(file["content"])
        magic, size = struct.unpack_from("<II", content)
        assert magic == warc.DICTIONARY_FRAME and size <= warc.DICTIONARY_BYTES
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        found = [frame for kind, frame in warc.frames(memoryview(content)) if kind is None]
        for frame in reversed(found):
            record = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(bytes(frame))
            assert record.startswith(b"WARC/1.1\r\n")
            seen += 1
    assert seen == pages(spark).count()


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_records_are_valid_and_files_are_rolled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENTS", 2)
    rows = [(i % 900, f"http://x/{i}", f"<p>{'common words ' * 40}{i % 700}</p>") for i in range(1_000)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "archive")
    warc.write_archives(pages, path, date="2024-01-02T03:04:05Z", segment_bytes=40_000)
    files = sorted((tmp_path / "archive").glob("part-*"))
    assert len(files) > 4
    fields = []
    for file in files:
        content = file.read_bytes()
        assert content.startswith(warc.struct.pack("<I", warc.DICTIONARY_FRAME))
        fields += [one for one, _ in warc.records(memoryview(content))]
    assert len(fields) == 1_001 == len({one["WARC-Record-ID"] for one in fields})
    assert {one["WARC-Date"] for one in fields} == {"2024-01-02T03:04:05Z"}
    back = warc.read_archives(spark, path)
    assert sorted((r[0] is None, r[0] or 0) for r in back.select("page_id").collect()) == sorted((r[0] is None, r[0] or 0) for r in rows)


def test_dictionary_of_a_table_with_a_hot_payload(spark):
    hot, rare = "<p>hot</p>" * 30, [f"<div>{i} {'text ' * 30}{i * 7919}</div>" for i in range(300)]
    pages = spark.createDataFrame([(i, hot if i % 2 else rare[i // 2 % 300]) for i in range(4_000)], "page_id long, html string")
    assert warc.trained_dictionary(pages, "html").count(b"hot") < 40
