"""The URL filter: false positives of the Bloom filter, repeated rows, long URLs, null and clashing columns."""

from pyspark.sql import functions as F

from graphspark.llm import queries, urls


def test_false_positives_of_the_filter_are_removed(spark):
    """Keys that pass the filter without being listed exist, and the exact join takes them out."""
    listed = spark.range(20_000).select(F.concat(F.lit("h.org|/"), "id").alias("key"))
    blocks = 20  # a filter far too small for its list
    known = listed.select(F.concat(F.lit("u|"), "key").alias("key"))
    asked = spark.range(20_000, 21_000).select(F.concat(F.lit("u|h.org|/"), "id").alias("key"))
    passed = urls.possible(asked, urls.bloom_filter(known, blocks), blocks, True)
    assert passed.count() > 0 and passed.join(known, "key").count() == 0
    pages = spark.range(19_990, 21_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h.org/"), "id").alias("url"))
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = urls.url_verdicts(pages, rules, listed).where("verdict = 'block'").select("page_id").collect()
    assert {r[0] for r in got} == set(range(19_990, 20_000))


def test_the_querys_list_does_not_depend_on_the_pages(spark, small):
    listed = queries.listed_pages(spark)
    assert listed.count() == listed.distinct().count() == 432_000
    assert listed.where("key = 'blog.adult-x.example.net|/es/999.html'").count() == 1
    judged = queries.op5_url_filter(spark, "/root/testdata/sf0.01")
    assert judged.where("verdict = 'block' and rule is null").count() > 0


def test_repeated_ids_are_judged_each(spark):
    rows = [(1, "http://a.org/x", "s"), (1, "http://b.org/x", "s"), (1, "http://b.org/x", "s"), (None, "http://a.org/x", "s"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("rule", F.lit("r")).withColumn("key", F.lit("k"))
    rules = spark.createDataFrame([("a.org", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = urls.url_verdicts(pages, rules, spark.createDataFrame([], "key string")).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in got) == [
        (0, "", "allow"), (0, "a.org", "block"), (1, "a.org", "block"), (1, "b.org", "allow"), (1, "b.org", "allow")
    ]


def test_long_hosts_and_paths(spark):
    host = ".".join(["x"] * 20_000) + ".a.org"
    pages = spark.createDataFrame([(1, f"http://{host}/p"), (2, "http://a.org/" + "q" * 200_000), (3, "http://a.org/" + "/" * 200_000 + "z")], "page_id long, url string")
    rules = spark.createDataFrame([("a.org", "/", "block"), ("a.org", "/" + "q" * 1000, "allow")], "host string, path string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages, rules, spark.createDataFrame([], "key string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}
