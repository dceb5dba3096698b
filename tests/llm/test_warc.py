import gzip
import hashlib
import os

from hornbeam.llm import warc
from hornbeam.llm.common import local_path, new_folder

SCHEMA = "page_id long, url string, html string, refers_to string, bytes long"


def test_round_trip(spark):
    big = "<p>" + "x" * 700_000 + "é</p>"
    same = "y" * 1000
    pages = [(1, "http://a/ b\n", big), (2, None, same), (9, "u", same), (4, "u", same), (5, "u", "y" * 999), (6, "u", "y" * 999), (7, "u", None), (8, "u", ""), (None, None, same), (9, "u", same)]
    df = spark.createDataFrame([(*p, "zz", 1) for p in pages], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in warc.round_trip(spark, df).filter("page_id is not null").collect())

    def want(i, html, kind, ref):
        data = (html or "").encode()
        return (i, len(data), hashlib.sha1(data).hexdigest(), kind, ref)

    assert got == sorted([want(1, big, "response", None), want(2, same, "revisit", 9), want(4, same, "revisit", 9), want(9, same, "response", None), want(9, same, "response", None), want(5, "y" * 999, "response", None), want(6, "y" * 999, "response", None), want(7, "", "response", None), want(8, "", "response", None)])
    assert warc.round_trip(spark, df).filter("page_id is null").first()["record_type"] == "response"
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_chunk_rows_rebuild_payloads(spark):
    text = "".join(chr(97 + i % 26) for i in range(600_000))
    df = spark.createDataFrame([(1, "u", text), (2, "u", "")], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    files = warc.write_archives(spark, df.repartition(1), folder)
    rows = sorted(warc.read_archives(files, folder).collect(), key=lambda r: (r["page_id"], r["chunk_no"]))
    one = [r for r in rows if r["page_id"] == 1]
    assert len(one) > 2 and max(len(r["chunk"]) for r in one) <= warc.CHUNK
    assert b"".join(bytes(r["chunk"]) for r in one).decode() == text
    so_far = hashlib.sha1()
    for r in one:
        so_far.update(bytes(r["chunk"]))
        assert r["sha1_so_far"] == so_far.hexdigest()
    assert [r["last"] for r in one] == [False] * (len(one) - 1) + [True]
    name = files.first()["file"]
    head = gzip.open(os.path.join(local_path(folder), name)).read(200)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_archives_rotate(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    folder = new_folder(spark, "warc")
    df = spark.createDataFrame([(i, "u", "z" * i) for i in range(5)], "page_id long, url string, html string").repartition(1)
    assert warc.write_archives(spark, df, folder).count() in (1, 5)


def test_record_ids_are_unique(spark):
    same = "y" * 1500
    pages = [(1, "u", "a"), (1, "u", "b"), (None, "u", "c"), (None, "v", "c"), (None, "v", same), (3, "u", same), (3, "v", same), (2, "u", same), (4, "u", same + "z"), (5, "u", same + "z"), (1, "u", "a")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = new_folder(spark, "warc")
    rows = warc.read_archives(warc.write_archives(spark, df, folder), folder).collect()
    assert len(rows) == len(pages) == len({(r["record_id"], r["chunk_no"]) for r in rows})
    assert sorted((r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit") == [(2, 3), (4, 5)]
    heads = {f["WARC-Record-ID"]: f for r in os.listdir(local_path(folder)) for f, chunks in warc.records(os.path.join(local_path(folder), r)) if list(chunks) is not None}
    (four,) = [f for f in heads.values() if f.get("X-Page-Id") == "4"]
    assert heads[four["WARC-Refers-To"]]["X-Page-Id"] == "5"
