"""Rule lists with more path lengths than a few thousand."""

from graphspark.llm import urls


def test_the_longest_of_many_rule_paths_fits(spark):
    n = 4200
    rules = spark.createDataFrame([(f"h{i}.org", "/" + "a" * i, "block") for i in range(n)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://h{n - 1}.org/{'a' * n}"), (2, f"http://h{n - 1}.org/a")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages, rules, spark.createDataFrame([], "key string")).collect()}
    assert got == {1: "block", 2: "allow"}
