"""Sinks: product store, run summary, search index, feed and sitemap files, review cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_products(products: DataFrame, path: str) -> None:
    """The source of truth: parquet by chain. Rows of a chain are spread over files by record, so a large chain isn't one task."""
    products.repartition("chain", F.pmod(F.xxhash64("product_id"), F.lit(8))).write.mode("overwrite").partitionBy("chain").parquet(path)


def export_json(products: DataFrame, path: str) -> None:
    """JSON lines by chain, nulls kept."""
    products.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("chain").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's small summary as one JSON file, overwritten each run."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """Text files of one column: feed items, sitemap entries, search rows as JSON."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_news(news: DataFrame, path: str) -> None:
    """News partitioned by year, as :func:`menuflow.sources.landed.news_of` reads them."""
    news.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)
