import base64
import hashlib

from pyspark.sql import functions as F

from motifloom.llm.warc import assemble, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, record_id string"


def captures(spark, rows, **how):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    out = assemble(read_warc(spark, write_warc(pages, **how)), apart="file")
    about = F.from_json(F.col("metadata.body").cast("string"), "page_id long, url string, payload_bytes long")
    return out.withColumn("about", about).collect()


def test_round_trip(spark):
    rows = [
        (1, "http://a/x", "same"), (2, "http://a/y?q= ü\n", "same"), (3, None, "same"), (4, "http://b", None), (5, "http://b", ""), (6, "", "other ü 😀"), (7, "http://c", "WARC/1.1\r\n\r\n" * 50),
        (7, "http://c", "WARC/1.1\r\n\r\n" * 50), (None, "http://n", "null id"), (None, "http://n", "same"),
    ]
    got = captures(spark, rows)
    assert len(got) == len(rows)
    assert sorted((r["about"]["page_id"] or -1, r["about"]["url"] or "-") for r in got) == sorted((i if i is not None else -1, u or "-") for i, u, _ in rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["about"]["page_id"], []).append(r)
    for i, _, html in rows:
        for r in by_id[i]:
            own = r["response"]
            if i is not None:
                assert own["payload_digest"] == base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
            assert r["request"]["concurrent_to"] == r["metadata"]["concurrent_to"] == own["record_id"] == r["capture_id"]
    kind = lambda i: [r["response"]["type"] for r in by_id[i]]
    assert kind(1) == kind(2) == ["revisit"] and kind(3) == ["response"] and kind(4) == ["revisit"] and kind(5) == ["response"] and kind(7) == ["response", "response"]
    assert by_id[1][0]["response"]["refers_to"] == by_id[3][0]["response"]["record_id"]
    assert bytes(by_id[6][0]["response"]["body"]).decode() == "other ü 😀"
    assert sorted(kind(None)) == ["response", "revisit"]


def test_small_payloads_are_responses(spark):
    got = captures(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], min_payload_bytes=4)
    assert sorted((r["about"]["page_id"], r["response"]["type"]) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_files_are_split_and_empty_tables_write_none(spark, monkeypatch):
    from motifloom.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50, "") for i in range(40)], SCHEMA)
    manifest = write_warc(pages)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == 120
    assert assemble(read_warc(spark, manifest)).filter("response is not null and request is not null and metadata is not null").count() == 40
    assert assemble(read_warc(spark, write_warc(pages.limit(0)))).count() == 0


def test_captures_across_files(spark):
    """Records of other files, of requests that are named instead of the response, and odd ones."""
    rows = [
        ("a", "r1", "response", None), ("b", "q1", "request", "r1"), ("c", "m1", "metadata", "r1"), ("a", "m2", "metadata", "q1"), ("d", "q2", "request", "r1"), ("d", "x1", "conversion", "r1"),
        ("a", "r2", "revisit", None), ("b", "m3", "metadata", "r2"), ("c", "q9", "request", None), ("c", "m9", "metadata", "q9"), ("c", "i1", "warcinfo", None), ("c", None, None, None),
    ]
    records = spark.createDataFrame(rows, "file string, record_id string, type string, concurrent_to string")
    names = lambda x: [r["record_id"] for r in x]
    got = {r["capture_id"]: ((r["response"] or {"record_id": None})["record_id"], names(r["requests"]), names(r["metadatas"]), names(r["others"])) for r in assemble(records).collect()}
    assert got == {
        "r1": ("r1", ["q1", "q2"], ["m1", "m2"], ["x1"]), "r2": ("r2", [], ["m3"], []), "q9": (None, ["q9"], ["m9"], []), "i1": (None, [], [], ["i1"]), None: (None, [], [], [None]),
    }
    apart = assemble(records, apart="file").filter("capture_id = 'r1'").collect()
    assert sorted((r["file"], len(r["requests"]) + len(r["metadatas"]) + len(r["others"])) for r in apart) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_a_payload_of_most_rows_is_dealt(spark, monkeypatch):
    from motifloom.llm import warc

    monkeypatch.setattr(warc, "HOT_ROWS", 5)
    got = captures(spark, [(i, "u", "hot " * 30_000 if i % 3 else f"own {i}") for i in range(60)])
    assert sorted(r["about"]["page_id"] for r in got) == list(range(60))
    hot = [r for r in got if r["about"]["page_id"] % 3]
    (response,) = [r["response"] for r in hot if r["response"]["type"] == "response"]
    assert [r["about"]["page_id"] for r in hot if r["response"]["type"] == "response"] == [59]
    assert {r["response"]["refers_to"] for r in hot if r["response"]["type"] == "revisit"} == {response["record_id"]}
