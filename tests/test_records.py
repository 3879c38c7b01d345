"""Page and log sources, and the sinks, on small inputs."""

from lettings.sources import records as R

PAGE = '<html><script id="__NEXT_DATA__" type="application/json">{"props": {"results": [{"id": 1, "price": 2000}, {"id": 2, "price": "x"}]}}</script></html>'


def test_embedded_listings(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None), (4, '<script id="__NEXT_DATA__">{broken</script>')], "page_id int, html string")
    got = R.embedded_listings(pages, "$.props.results", "id long, price long").select("page_id", "record.*").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, 2000), (1, 2, None)]
    assert R.embedded_listings(pages.limit(0), "$.props.results", "id long").isEmpty()


def test_log_stats(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024 ERROR one\n'item_scraped_count': 42,\n'finish_reason': 'finished',\n2024 ERROR two\n")
    (tmp_path / "b.log").write_text("nothing\n")
    got = R.log_stats(spark, f"{tmp_path}/*.log").collect()
    assert sorted(map(tuple, got)) == [("a.log", 42, "finished", 2), ("b.log", None, None, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("sw1", "savills", 1, "a, b"), ("sw3", "foxtons", 2, None)], "area string, source string, id long, note string")
    for _ in range(2):
        R.append_json_lines(df, f"{tmp_path}/j")
    assert spark.read.schema("id long, note string, area string, source string").json(f"{tmp_path}/j").count() == 4
    R.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, spark.read.option("header", True).schema(df.schema).csv(f"{tmp_path}/c").collect())) == sorted(map(tuple, df.collect()))
