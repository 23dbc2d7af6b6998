"""Views over stored items: groups, months, change logs, search rows, feeds, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_events(products: DataFrame, *, keys: Sequence[str], history: str = "price_history") -> DataFrame:
    """(keys, pos, date, old, new, diff): neighbouring told prices of a history array that differ.

    Works on the array of each record: no shuffle. Entries without a price are skipped, first captures are no events.
    """
    told = F.filter(F.coalesce(F.col(history), F.array()), lambda e: e["price"].isNotNull())
    pairs = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda i: F.struct(i.alias("pos"), F.get("_t", i)["date"].alias("date"), F.get("_t", i - 1)["price"].alias("old"), F.get("_t", i)["price"].alias("new")))
    out = products.select(*keys, told.alias("_t")).where(F.size("_t") > 1).select(*keys, F.inline(pairs))
    return out.where(F.col("old") != F.col("new")).withColumn("diff", F.col("new") - F.col("old"))


def variant_price_events(products: DataFrame, *, keys: Sequence[str], history: str = "variant_history") -> DataFrame:
    """(keys, date, label, old, new, diff): price changes of a record, for each label of a variant and, with a null label, the first one, which stands for the item.

    ``history`` is an array of (date, variants), variants an array of (label, price). A label is compared with the same label one
    entry before; null and equal prices are no events. A variant's event that says the same (date, old, new) as the item's own is left out.
    Works on the array of each record: no shuffle.
    """
    at = lambda i: F.get(history, i)
    price_of = lambda e, label: F.get(F.filter(e["variants"], lambda v: v["label"] == label), F.lit(0))["price"]
    event = lambda label, i, old, new: F.struct(at(i)["date"].alias("date"), label.alias("label"), old.alias("old"), new.alias("new"))
    base = F.transform(F.col("_i"), lambda i: event(F.lit(None).cast("string"), i, at(i - 1)["variants"][0]["price"], at(i)["variants"][0]["price"]))
    each = F.flatten(F.transform(F.col("_i"), lambda i: F.transform(at(i)["variants"], lambda v: event(v["label"], i, price_of(at(i - 1), v["label"]), v["price"]))))
    differs = lambda e: e["old"].isNotNull() & e["new"].isNotNull() & (e["old"] != e["new"])
    told = products.where(F.size(history) > 1).withColumn("_i", F.sequence(F.lit(1), F.size(history) - 1)).select(*keys, F.filter(base, differs).alias("_b"), F.filter(each, differs).alias("_v"))
    same = lambda v: F.exists("_b", lambda b: b["date"].eqNullSafe(v["date"]) & (b["old"] == v["old"]) & (b["new"] == v["new"]))
    return told.select(*keys, F.inline(F.concat("_b", F.filter(F.array_distinct("_v"), lambda v: ~same(v))))).withColumn("diff", F.col("new") - F.col("old"))


def latest_date(*dates: Column) -> Column:
    """The latest of several dates, nulls left out."""
    return F.array_max(F.filter(F.array(*dates), lambda d: d.isNotNull()))


def page_lastmod(items: DataFrame, *, chain: str, month: str, lastmod: str) -> DataFrame:
    """(page, lastmod, n): the newest change of the top page, of each chain's and of each month's, by grouping sets."""
    by = items.groupingSets([[], [F.col(chain)], [F.col(month)]], F.col(chain), F.col(month)).agg(F.max(lastmod).alias("lastmod"), F.count(F.lit(1)).alias("n"), F.grouping(F.col(chain)).alias("_gc"), F.grouping(F.col(month)).alias("_gm"))
    page = F.when((F.col("_gc") == 1) & (F.col("_gm") == 1), F.lit("/")).when(F.col("_gc") == 0, F.concat(F.lit("/chain/"), F.coalesce(F.col(chain), F.lit("")))).otherwise(F.concat(F.lit("/archive/"), F.coalesce(F.col(month), F.lit(""))))
    return by.select(page.alias("page"), "lastmod", "n")


def search_rows(items: DataFrame, *, name: Column, url: Column, chain: Column, chain_name: Column, date: Column, status: Column) -> DataFrame:
    """The rows of a client-side search index: n, u, c, cn, d, s."""
    return items.select(name.alias("n"), url.alias("u"), chain.alias("c"), chain_name.alias("cn"), date.alias("d"), status.alias("s"))


def search(index: DataFrame, text: str, *, columns: Sequence[str] = ("n",), order: Sequence[Column | str] = ("n",), limit: int = 50) -> DataFrame:
    """The first ``limit`` rows that contain ``text`` in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit |= F.contains(F.lower(c), F.lit(text.lower()))
    return index.where(hit).orderBy(*order).limit(limit)


def places(rows: DataFrame, *, scope: Sequence[str], group: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows with ``pos``: their place in the scope by group (nulls last) and ``order``. Places are counted within a group and shifted by the sizes of
    the groups before it, which are a small table, so only a group is sorted in one task."""
    inner = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*scope, group).orderBy(*order)))
    sizes = rows.groupBy(*scope, group).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*scope).orderBy(F.asc_nulls_last(group)).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*(F.col(c).alias(f"_s_{c}") for c in scope), F.col(group).alias("_g"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    on = F.col(group).eqNullSafe(F.col("_g"))
    for c in scope:
        on &= F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return inner.join(shifts, on).withColumn("pos", F.col("_n") + F.col("_shift")).drop("_n", "_shift", "_g", *(f"_s_{c}" for c in scope))


def run_priority(runs: DataFrame, *, blocked: str, failed: str, many: int) -> DataFrame:
    """Runs with ``priority`` (high where something was blocked, default where more than ``many`` failed, else low) and ``exit_code``."""
    return runs.withColumns({"priority": F.when(F.col(blocked) > 0, "high").when(F.col(failed) > many, "default").otherwise("low"), "exit_code": (F.col(blocked) > 0).cast("int")})


def even_slots(groups: DataFrame, *, n: str, order: Sequence[str], least: int = 12, most: int = 3) -> DataFrame:
    """Groups of more than ``least`` items, at most ``most`` of them, evenly spread over the order."""
    eligible = groups.where(F.col(n) > least)
    w = Window.orderBy(*order)  # the groups of one page: a bounded list
    ranked = eligible.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * F.col("_n") / most))
    return ranked.where((F.col("_n") <= most) | F.array_contains(chosen, F.col("_r").cast("bigint"))).drop("_r", "_n")


def page_description(names: Column, prefix: Column, limit: int = 125, most: int = 3) -> Column:
    """The prefix with as many of the first names as fit into ``limit`` signs."""
    options = [F.concat(prefix, F.array_join(F.slice(names, 1, k), "、")) for k in range(most, 0, -1)]
    return F.coalesce(*(F.when((F.length(o) <= limit) & (F.size(names) >= 1), o) for o in options), prefix)


def feed_xml(title: Column, link: Column, date: Column, description: Column) -> Column:
    """One RSS item."""
    from menuflow.functions.text import escape_html

    return F.concat(F.lit("<item><title>"), escape_html(title), F.lit("</title><link>"), escape_html(link), F.lit("</link><pubDate>"), F.date_format(date, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900</pubDate><description>"), escape_html(description), F.lit("</description></item>"))


def sitemap_xml(url: Column, lastmod: Column) -> Column:
    """One sitemap entry; without a date if there is none."""
    return F.concat(F.lit("<url><loc>"), url, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), lastmod.cast("string"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))


def json_ld(**fields: Column) -> Column:
    """A JSON-LD object with ``<`` escaped, so it can stand in a page."""
    return F.replace(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), F.lit("<"), F.lit("\\u003c"))
