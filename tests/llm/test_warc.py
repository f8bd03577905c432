from pyspark.sql import functions as F

from labarr.llm import queries, warc


def manifest(spark, rows):
    return warc.manifest(spark.createDataFrame(rows, "a string, o long, c string").withColumn("c", F.col("c").cast("binary")), "a", "o", "c")


def differences(spark, left, right, **kw):
    return sorted((r["archive"] or "", -1 if r["offset"] is None else r["offset"], r["status"]) for r in warc.audit(manifest(spark, left), manifest(spark, right), **kw).collect())


def test_located_differences_equal_brute_force(spark):
    left = [(f"w{a}", i * 10, f"record {a} {i}") for a in range(3) for i in range(200)]
    right = [r for r in left if r != ("w1", 500, "record 1 50")]
    right[17] = ("w0", 170, "flipped")
    right.append(("w2", 123456, "new"))
    for kw in ({"span": 64, "fanout": 4}, {"span": 1 << 16}, {"span": 10, "fanout": 2}):
        assert differences(spark, left, right, **kw) == [("w0", 170, "corrupt"), ("w1", 500, "missing"), ("w2", 123456, "extra")]
    assert differences(spark, left, left) == [] and differences(spark, [], []) == []
    assert len(differences(spark, left, [])) == 600


def test_nulls_ties_and_repeats(spark):
    left = [("a", 0, "x"), ("a", 0, "x"), ("a", 0, "y"), (None, 5, "n"), ("a", None, "o"), ("a", 7, None)]
    right = [("a", 0, "x"), (None, 5, "m"), ("a", None, "o"), ("a", 7, "z")]
    assert differences(spark, left, right) == [("", 5, "corrupt"), ("a", 0, "missing"), ("a", 0, "missing"), ("a", 7, "corrupt")]


def test_records_are_written_and_read(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<p>ü</p>\r\n\r\nx"), (2, None, None)], "id long, url string, html string")
    one = pages.select("id", warc.record(F.col("url"), F.col("id"), F.col("html")).alias("r")).orderBy("id").collect()
    whole = b"".join(bytes(r["r"]) for r in one)
    files = spark.createDataFrame([("f", bytearray(whole)), ("cut", bytearray(whole[:150])), ("none", None), ("noise", bytearray(b"abc" + whole))], "path string, content binary")
    got = {(r["path"], r["offset"]): r for r in warc.parse(files).collect()}
    first = got["f", 0]
    assert bytes(first["body"]).decode() == "<p>ü</p>\r\n\r\nx" and first["headers"]["WARC-Target-URI"] == "http://a/é"
    assert first["length"] == len(bytes(one[0]["r"])) and ("f", first["length"]) in got and bytes(got["f", first["length"]]["body"]) == b""
    assert ("noise", 3) in got and ("cut", 0) in got and not any(p == "none" for p, _ in got)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    ids = [r["page_id"] for r in queries.table(spark, sf, "pages").collect()]
    got = {(r["page_id"], r["status"]) for r in queries.op4_warc(spark, sf).collect()}
    assert got == {(i, "missing") for i in ids if i % 77 == 5} | {(i, "corrupt") for i in ids if i % 50 == 3 and i % 77 != 5}
