"""Landed files: pages and answers that a fetcher has stored, record stores, news by year.

The engine never fetches: a run's pages are files, one row each, with status and permission. What is
blocked, missing or forbidden is told from the row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_PAGES = "chain string, run_date date, run_seq int, kind string, page_ord int, category string, url string, http_status int, allowed boolean, body string"
PRICE = "array<struct<date:string,price:int,relaunch:boolean>>"
PRODUCT = (
    "chain string, product_id string, name string, category string, price int, limited_kind string, launch_date string, launch_date_source string, official_url string, "
    f"first_seen_at string, last_seen_at string, status string, ended_observed_at string, missed_runs int, price_history {PRICE}, is_regular boolean, source_list array<string>"
)
# Words of pages that a bot guard serves instead of the page.
CHALLENGE = ("incapsula", "imperva", "_incap_", "request unsuccessful", "just a moment", "cf-chl", "access denied")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as JSON lines; a line that can't be read has nulls and stands whole in ``corrupt`` (see :func:`corrupt_lines`)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{RAW_PAGES}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("_j")).select("_j.*")


def corrupt_lines(pages: DataFrame) -> DataFrame:
    """(line, reason): the lines of :func:`raw_pages` that couldn't be read, for the dead letters."""
    return pages.where("corrupt is not null").select(F.col("corrupt").alias("line"), F.lit("unreadable").alias("reason"))


def binary_pages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(url, content, kind, body, fetched_at): whole files. ``kind`` is ``pdf`` or ``text``, by the first bytes; only texts have a ``body``, decoded as UTF-8 with replacement."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    pdf = is_pdf(F.col("content"))
    return files.select(F.col("path").alias("url"), "content", F.when(pdf, "pdf").otherwise("text").alias("kind"), F.when(~pdf, F.decode("content", "UTF-8")).alias("body"), F.col("modificationTime").alias("fetched_at"))


def is_pdf(content: Column) -> Column:
    """Whether bytes are a PDF's: anything else that was fetched as one is a page of a bot guard."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def product_store(spark: SparkSession, path: str) -> DataFrame:
    """A store with one JSON file per product; malformed files are dropped."""
    return spark.read.schema(PRODUCT).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def is_challenge(body: Column, first: int = 4000) -> Column:
    """Whether a page is a bot guard's: one of the words stands near its beginning. (The feature looks at the head only.)"""
    head = F.lower(F.substring(body, 1, first))
    hit = F.lit(False)
    for word in CHALLENGE:
        hit |= F.contains(head, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def page_state(status: Column, body: Column) -> Column:
    """``ok``, ``blocked`` (refused, throttled or guarded), ``not_found`` or ``error``."""
    return F.when(status.isin(401, 403, 429) | is_challenge(body), "blocked").when(status == 404, "not_found").when(status.between(200, 299) & body.isNotNull(), "ok").otherwise("error")


def _rules(text: str | None) -> list[tuple[str, bool]] | None:
    """(path, allowed) of the group for all agents; None where the text is a page instead: all is allowed."""
    if text is None or "<html" in text.lower():
        return None
    found, mine, fresh = [], False, True
    for line in text.splitlines():
        name, _, value = line.split("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            mine = value == "*" or (mine and not fresh)
            fresh = False
        elif name in ("allow", "disallow"):
            fresh = True
            if mine and value:
                found.append((value, name == "allow"))
    return found


@F.pandas_udf(T.BooleanType())
def robots_allow(robots: pd.Series, path: pd.Series) -> pd.Series:
    """Whether a robots text allows a path: the longest matching rule decides; a missing text or a page allows all."""
    known: dict = {}
    out = []
    for r, p in zip(robots, path):
        if r not in known:
            known[r] = _rules(r)
        hits = [(len(rule), ok) for rule, ok in known[r] or () if (p or "/").startswith(rule)]
        out.append(max(hits)[1] if hits else True)
    return pd.Series(out)


def fetch_queue(wanted: DataFrame, *, scope: str = "chain", order: str = "ord", budget: int = 60, interval_s: int = 3) -> DataFrame:
    """(..., wait_s): the first ``budget`` addresses of each scope, each once, with when to fetch them at the earliest."""
    once = wanted.groupBy(scope, "url").agg(F.min(order).alias(order))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy(scope).orderBy(order, "url")))
    return ranked.where(F.col("_r") <= budget).select(scope, "url", order, ((F.col("_r") - 1) * interval_s).alias("wait_s"))


def news_of(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """News of a store partitioned by ``year``, only of the years that the dates touch (partition pruning)."""
    return spark.read.parquet(path).where(F.col("year").between(int(first[:4]), int(last[:4])) & F.col("date").between(first, last))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """A JSON value, or the default where it is missing or can't be read."""
    return F.coalesce(F.from_json(text, schema), default)
