import base64
import hashlib

from clademark.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "", None, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx", "<p>é</p>", "x" * 300000, "", "<p>é</p>"]
    rows = [(i + 10, f"http://a.org/{i} y", h, "") for i, h in enumerate(html)] + [(3, None, "<p>é</p>", ""), (None, "u", "null id", "")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, SCHEMA), path)
    got = warc.captures(warc.records(spark, path)).select("*", warc.page_id_of("metadata.fields").alias("page_id"), warc.page_id_of("origin.fields").alias("refers")).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault((h or "").encode(), i)
    by = {x.page_id: x for x in got}
    for i, u, h, _ in rows:
        x, payload = by[i], (h or "").encode()
        assert x.digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert x.request.record_id and x.metadata.fields
        if first[payload] == i:
            assert x.type == "response" and bytes(x.body) == payload and x.refers is None
        else:
            assert x.type == "revisit" and x.refers == first[payload] and x.origin.bytes == len(payload) and not x.body
        assert (x.uri is None) == (u is None)
    thin = warc.captures(warc.records(spark, path), bodies=False)
    assert "body" not in thin.columns and sorted((x.digest, x.bytes or 0) for x in thin.collect()) == sorted((x.digest, x.bytes or 0) for x in got)


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert warc.captures(warc.records(spark, str(tmp_path / "e"))).count() == 0
    assert "op8_warc" in queries.queries()


def test_repeated_rows_and_partitions(spark, tmp_path):
    rows = [(1, "http://a.org/", "same", "")] * 3 + [(i, f"http://a.org/{i}", f"page {i}", "") for i in range(2, 200)] + [(500 + i, "u", "same", "") for i in range(100)]
    path = str(tmp_path / "r")
    warc.write(spark.createDataFrame(rows, SCHEMA), path, file_bytes=300)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = warc.captures(warc.records(spark, path)).select("type", "body", "origin")
        assert got.filter("type = 'response'").count() == 199 and got.filter("type = 'revisit'").count() == 102
        assert got.filter("type = 'revisit' and origin.bytes = 4").count() == 102
        # Captures are dealt to more than one task, whatever they refer to.
        assert got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).filter(lambda n: n > 0).count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
