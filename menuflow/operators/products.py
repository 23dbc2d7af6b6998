"""Product records out of listing entries and details: building, kinds, seasons, variants, notes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_ROW = "struct<date:string,price:int,relaunch:boolean>"


@dataclass(frozen=True)
class Family:
    """What differs between families of sources: days of the announcement window, words of a launch and of no launch, how quotes are
    split, how many regular items a run may create, whether an incomplete run's list price counts, what a return does."""

    name: str
    before: int = 120
    after: int = 14
    launch_words: str = "発売|登場|販売開始|新登場"
    no_launch_words: str = "終了|価格改定"
    split_quotes: str | None = None
    drop_brackets: bool = False
    regular_budget: int | None = 20
    price_gated: bool = True
    seasons: bool = False


FAMILIES = {
    f.name: f
    for f in (
        Family("list_html", seasons=True),
        Family("json_api", regular_budget=None),
        Family("form_api", regular_budget=0, price_gated=False, seasons=True),
        Family("pdf_table", split_quotes="・", drop_brackets=True, price_gated=False),
        Family("press_only", before=90, seasons=True),
    )
}


def history_row(date: Column, price: Column, relaunch: Column | None = None) -> Column:
    return F.struct(date.cast("string").alias("date"), price.cast("int").alias("price"), (F.lit(None) if relaunch is None else relaunch).cast("boolean").alias("relaunch"))


def build(entries: DataFrame, details: DataFrame, *, keys: Sequence[str], now: Column, today: Column) -> DataFrame:
    """New records: entries joined with their details (missing ones stay null), on sale, seen today for the first time, with
    a price history of one row where a price is known. The detail's price stands before the list's."""
    e, d = entries.withColumnRenamed("price", "_list_price"), details.withColumnRenamed("price", "_detail_price")
    price = F.coalesce("_detail_price", "_list_price")
    seeded = F.when(price.isNotNull(), F.array(history_row(today, price))).otherwise(F.array().cast(f"array<{PRICE_ROW}>"))
    return e.join(d, [*keys], "left").withColumns({"price": price, "price_history": seeded, "status": F.lit("on_sale"), "missed_runs": F.lit(0), "first_seen_at": now, "last_seen_at": today}).drop("_list_price", "_detail_price")


def mark_regular(products: DataFrame, is_baseline: Column) -> DataFrame:
    """Baseline items become regular: no limited kind, no launch; the others lose the mark."""
    return products.withColumns(
        {
            "is_regular": F.when(is_baseline, F.lit(True)),
            "limited_kind": F.when(~is_baseline, F.col("limited_kind")),
            "launch_date": F.when(~is_baseline, F.col("launch_date")),
            "launch_date_source": F.when(~is_baseline, F.col("launch_date_source")),
        }
    )


def upgrade_regular(products: DataFrame, is_limited: Column, kind: Column) -> DataFrame:
    """Regular items that turn out limited lose the mark and take the kind."""
    turned = F.coalesce(F.col("is_regular"), F.lit(False)) & is_limited
    return products.withColumns({"is_regular": F.when(~turned, F.col("is_regular")), "limited_kind": F.when(turned, kind).otherwise(F.col("limited_kind"))})


def list_price(price: Column, complete: Column, family: Family) -> Column:
    """The list price as far as it may enter the history: from a gated family only of complete runs."""
    return F.when(complete, price) if family.price_gated else price


def append_price(history: Column, date: Column, price: Column) -> Column:
    """The history with a row for ``price`` unless it is null or the last told price."""
    told = F.filter(history, lambda h: h["price"].isNotNull())
    last = F.get(told, F.size(told) - 1)["price"]
    return F.when(price.isNull() | last.eqNullSafe(price), history).otherwise(F.concat(history, F.array(history_row(date, price))))


def new_season(products: DataFrame, returned: Column, today: Column) -> DataFrame:
    """Items that returned after their end: launch and end go into ``seasons``, are reset, and the price history takes a
    ``relaunch`` row unless it has one of today."""
    old = F.struct(F.col("launch_date").alias("launch_date"), F.col("ended_observed_at").cast("string").alias("ended"))
    day = today.cast("string")
    has = F.exists("price_history", lambda h: h["relaunch"].eqNullSafe(F.lit(True)) & (h["date"] == day))
    row = F.array(history_row(today, F.col("price"), F.lit(True)))
    return products.withColumns(
        {
            "seasons": F.when(returned, F.concat(F.coalesce("seasons", F.array().cast("array<struct<launch_date:string,ended:string>>")), F.array(old))).otherwise(F.col("seasons")),
            "price_history": F.when(returned & ~has, F.concat("price_history", row)).otherwise(F.col("price_history")),
            "launch_date": F.when(~returned, F.col("launch_date")),
            "ended_observed_at": F.when(~returned, F.col("ended_observed_at")),
            "status": F.when(returned, F.lit("on_sale")).otherwise(F.col("status")),
        }
    )


def relabel_variants(variants: Column, single: str = "単品") -> Column:
    """Beside a variant labelled ``single`` the unlabelled ones are sets."""
    has = F.exists(variants, lambda v: v["label"].eqNullSafe(F.lit(single)))
    return F.when(has, F.transform(variants, lambda v: F.struct(F.coalesce(v["label"], F.lit(f"セット（{single}を含む）")).alias("label"), v["price"].alias("price")))).otherwise(variants)


def with_takeout(eat_in: Column, takeout: Column, mark: str = "（持ち帰り）") -> Column:
    """Eat-in variants and those takeout ones whose price differs from that of the same label."""
    prices = F.map_from_entries(F.transform(eat_in, lambda v: F.struct(F.coalesce(v["label"], F.lit("")), v["price"])))
    other = F.filter(takeout, lambda v: ~F.try_element_at(prices, F.coalesce(v["label"], F.lit(""))).eqNullSafe(v["price"]))
    return F.concat(eat_in, F.transform(other, lambda v: F.struct(F.concat(F.coalesce(v["label"], F.lit("")), F.lit(mark)).alias("label"), v["price"].alias("price"))))


def variant_changes(rows: DataFrame, *, keys: Sequence[str], at: str, variants: str) -> DataFrame:
    """(keys, at, old, new): observations whose set of variants differs from the one before; sets of fewer than two say nothing."""
    w = Window.partitionBy(*keys).orderBy(at)
    told = rows.where(F.size(variants) >= 2).withColumn("_v", F.array_sort(variants)).withColumn("_o", F.lag("_v").over(w))
    return told.where(F.col("_o").isNotNull() & (F.col("_o") != F.col("_v"))).select(*keys, at, F.col("_o").alias("old"), F.col("_v").alias("new"))


def price_note(*parts: tuple[Column, str]) -> Column:
    """A note out of the texts whose conditions hold."""
    return F.nullif(F.concat_ws("", *(F.when(c, F.lit(t)) for c, t in parts)), F.lit(""))


def representative(rows: DataFrame, *, keys: Sequence[str], size: str, values: Sequence[str], first: str = "並盛") -> DataFrame:
    """(keys, values, variants, dropped): of an item's table rows the one of size ``first`` - else the first by size - stands for it;
    all rows are variants where there are two or more; rows without any value are dropped and counted."""
    told = F.coalesce(*(F.col(v).cast("string") for v in values)).isNotNull()
    row = F.struct((F.col(size) != first).cast("int").alias("o"), F.col(size).alias("size"), *values)
    by = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(told, row))).alias("_r"), F.count_if(~told).alias("dropped"))
    pick = F.get("_r", F.lit(0))
    return by.select(*keys, *(pick[v].alias(v) for v in values), F.when(F.size("_r") >= 2, F.transform("_r", lambda r: F.struct(r["size"].alias("size"), *(r[v].alias(v) for v in values)))).alias("variants"), "dropped")


def allergens(marks: DataFrame, *, keys: Sequence[str], name: str, mark: str, contains: str = "●", partial: str = "△") -> DataFrame:
    """(keys, contains, partial): allergens of all sizes of an item; one contained in any size is contained."""
    by = marks.groupBy(*keys, name).agg(F.bool_or(F.col(mark) == contains).alias("_c"), F.bool_or(F.col(mark) == partial).alias("_p"))
    return by.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.coalesce("_c", F.lit(False)), F.col(name)))).alias("contains"),
        F.array_sort(F.collect_list(F.when(F.coalesce(F.col("_p") & ~F.coalesce("_c", F.lit(False)), F.lit(False)), F.col(name)))).alias("partial"),
    )
