import datetime as dt
import json

from pyspark.sql import functions as F

from menuflow.sources import landed, sinks


def test_pages_states_and_robots(spark, tmp_path, rows):
    lines = [{"chain": "a", "run_date": "2026-01-01", "run_seq": 1, "url": f"u{i}", "http_status": s, "body": b} for i, (s, b) in enumerate([(200, "<p>ok"), (403, ""), (404, "x"), (200, "Just a moment..."), (500, "x"), (200, None)])]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    every = landed.raw_pages(spark, str(tmp_path / "p.json"))
    assert rows(landed.corrupt_lines(every)) == [("{broken", "unreadable")]
    pages = every.where("corrupt is null")
    assert rows(pages.select("url", landed.page_state(F.col("http_status"), F.col("body")))) == [("u0", "ok"), ("u1", "blocked"), ("u2", "not_found"), ("u3", "blocked"), ("u4", "error"), ("u5", "error")]
    assert landed.binary_pages(spark, str(tmp_path), "*.json").count() == 1
    robots = "User-agent: Bot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/open # x\n"
    df = spark.createDataFrame([(robots, "/private/a"), (robots, "/private/open/b"), (robots, "/menu"), ("<html>404</html>", "/private"), (None, "/"), ("User-agent: Bot\nDisallow: /", "/menu")], "r string, p string")
    assert [x[0] for x in df.select(landed.robots_allow("r", "p")).collect()] == [False, True, True, True, True, True]


def test_queue_keeps_budget_and_interval(spark, rows):
    df = spark.createDataFrame([("a", "u1", 1), ("a", "u1", 5), ("a", "u2", 2), ("a", "u3", 3), ("b", "u1", 1)], "chain string, url string, ord int")
    assert rows(landed.fetch_queue(df, budget=2)) == [("a", "u1", 1, 0), ("a", "u2", 2, 3), ("b", "u1", 1, 0)]


def test_stores(spark, tmp_path, rows):
    products = spark.createDataFrame([("a", "1", "n", None, 5), ("b", "2", None, "c", None)], "chain string, product_id string, name string, category string, price int")
    sinks.write_products(products, str(tmp_path / "store"))
    assert rows(spark.read.parquet(str(tmp_path / "store")).select("chain", "product_id", "price")) == [("a", "1", 5), ("b", "2", None)]
    sinks.export_json(products, str(tmp_path / "json"))
    assert '"name":null' in "".join(p.read_text() for p in (tmp_path / "json").rglob("*.json"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "1.json").write_text(json.dumps({"chain": "a", "product_id": "1", "price": 3}, indent=1))
    (tmp_path / "one" / "2.json").write_text("{broken")
    assert rows(landed.product_store(spark, str(tmp_path / "one")).where("product_id is not null").select("product_id", "price")) == [("1", 3)]
    sinks.write_summary(products.groupBy("chain").count(), str(tmp_path / "summary"))
    sinks.write_lines(products, "product_id", str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["1", "2"]


def test_news_reads_only_its_years(spark, tmp_path, rows):
    news = spark.createDataFrame([(dt.date(y, 6, 1), f"t{y}") for y in (2024, 2025, 2026)], "date date, title string")
    sinks.write_news(news, str(tmp_path / "news"))
    found = landed.news_of(spark, str(tmp_path / "news"), "2025-01-01", "2026-12-31")
    assert rows(found.select("title")) == [("t2025",), ("t2026",)]
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()
    got = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "t string").select(landed.json_or(F.col("t"), "a int", F.struct(F.lit(9).alias("a")))["a"].alias("a"))
    assert sorted((r["a"] for r in got.collect()), key=lambda x: x or 0) in ([1, 9, None], [None, 1, 9], [1, 9, 9])


def test_binaries_are_told_by_their_first_bytes(spark, tmp_path, rows):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7\n\xff\xfe")
    (tmp_path / "b.pdf").write_bytes("<html>待って".encode())
    found = landed.binary_pages(spark, str(tmp_path), "*.pdf").select(F.regexp_extract("url", "([abc])[.]pdf$", 1), "kind", "body")
    assert rows(found) == [("a", "pdf", None), ("b", "text", "<html>待って")]
