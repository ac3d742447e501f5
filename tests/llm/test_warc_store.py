import brute
import pytest

from corpusloom.llm import queries as q
from corpusloom.llm import warc_store as ws

SF = "/root/testdata/sf0.001"


def test_query_is_the_contract(spark):
    got = {r[0]: tuple(r)[1:] for r in q.op9_warc(spark, SF).collect()}
    assert got == brute.op9(brute.rows(f"{SF}/pages.parquet", "page_id", "html"))


def test_odd_pages_round_trip(spark):
    long = "é" * 200
    pages = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", long), (7, "u", "y" * 500_000), (2, None, long)]
    df = spark.createDataFrame([(*p, 1, "d") for p in pages], "page_id long, url string, html string, size int, payload_digest string")
    headers, payloads = ws.write_archive(df)
    assert payloads.count() == payloads.distinct().count() == len({h or "" for _, _, h in pages})
    rows = ws.records(headers, payloads).collect()
    assert sorted(((r.page_id, bytes(r.payload)) for r in rows), key=repr) == sorted(((p, (h or "").encode()) for p, _, h in pages), key=repr)
    by = {r.page_id: r for r in rows}
    assert by[1].record_type == "response" and (by[2].record_type, by[2].refers_to) == ("revisit", 1)
    assert by[5].record_type == by[6].record_type == by[None].record_type == "response"
    assert by[1].url == "http://a/\r\nX: y" and by[2].url is None
    assert len(ws.read_back(headers, payloads).collect()) == len(pages)
    bodies = [x for s in ws.segments(ws.rebuilt(headers, payloads), most=1000).collect() for x in ws.parse_segment(bytes(s.segment))]
    assert len(bodies) == len(pages) and sorted(h for h, _ in bodies) == sorted(bytes(r.header) for r in rows)
    assert len({ws.header_fields(h)[b"WARC-Record-ID"] for h, _ in bodies}) == len(pages)
    assert ws.read_back(*ws.write_archive(df.limit(0))).count() == 0


def test_recrawled_pages_keep_their_payloads(spark):
    a, b, c = ("abc"[i] * 150 for i in range(3))
    pages = [(1, "u", a), (2, "u", a), (2, "u", b), (3, "u", b), (3, "u", "short"), (4, "u", "short"), (4, "u", c)]
    headers, payloads = ws.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(bytes(r.payload).decode() for r in payloads.collect()) == sorted([a, b, c, "short"])
    rows = ws.read_back(headers, payloads).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in rows) == sorted((p, len(h)) for p, _, h in pages)
    assert sorted((r.page_id, r.refers_to) for r in rows if r.record_type == "revisit") == [(2, 1), (3, 2)]


def test_damage_is_an_error(spark):
    headers, payloads = ws.write_archive(spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string"))
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="damaged payload"):
        ws.records(headers, payloads.withColumn("payload", F.lit("other").cast("binary"))).collect()


def test_urls_come_back_and_forge_nothing(spark):
    a, b = "a" * 150, "b" * 150
    zero = "0" * 64
    urls = ["", "x%0Ay", "x%25\n%0D", "u\u2028WARC-Payload-Digest: sha256:" + zero, "u\u0085WARC-Refers-To: <urn:corpusloom:page:9:9>", "u\r\nWARC-Refers-To: <urn:corpusloom:page:9:9>\r\nX-Target-URI-Encoded: 1", "\n", None]
    pages = [(i, u, a if i % 2 else b + str(i)) for i, u in enumerate(urls)]
    headers, payloads = ws.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = {r.page_id: r for r in ws.read_back(headers, payloads).collect()}
    want = brute.op9([(p, h) for p, _, h in pages])
    assert {i: r.url for i, r in rows.items()} == dict(enumerate(urls))
    assert {i: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for i, r in rows.items()} == want


def test_payloads_of_rows_without_page_id(spark):
    pages = [(None, "u", "x" * 150)] * 3 + [(None, "u", "y" * 150), (5, "u", "y" * 150), (7, "u", "z" * 150), (7, "v", "z" * 150), (7, "u", "z" * 150)]
    headers, payloads = ws.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(bytes(r.payload)[:1] for r in payloads.collect()) == [b"x", b"y", b"z"]
    rows = ws.read_back(headers, payloads).collect()
    assert len(rows) == len(pages) and all(r.payload_bytes == 150 and r.record_type == "response" for r in rows)
    with pytest.raises(Exception, match="no payload"):
        ws.read_back(headers, payloads.limit(1)).collect()
