"""The life of listed items: sightings, misses, ends, returns; price and set changes; streaks and holds.

An absence only counts on a day whose run is complete. Nothing here builds a grid of
items by days: a day's place among the complete days of its scope is counted once on the small table of
runs, and the misses between two sightings of an item are a difference of two such places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_days(runs: DataFrame, *, scope: Sequence[str] = ("chain",), date: str = "run_date", ok: str = "ok", every: bool = False) -> DataFrame:
    """(scope, date, ok): whether a day is complete: any delivery of it ok, or, with ``every``, all of them."""
    flag = F.coalesce(F.col(ok), F.lit(False))
    return runs.where(F.col(date).isNotNull()).groupBy(*scope, date).agg((F.min(flag) if every else F.max(flag)).alias("ok"))


def _places(days: DataFrame, scope: Sequence[str], date: str) -> DataFrame:
    """(scope, date, ok, _place): the number of complete days up to and with the day."""
    w = Window.partitionBy(*scope).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("_place", F.sum(F.col("ok").cast("int")).over(w))


def episodes(sightings: DataFrame, days: DataFrame, *, scope: Sequence[str] = ("chain",), key: str = "product_id", date: str = "run_date", patience: int = 2) -> DataFrame:
    """(scope, key, episode, started, last_seen, missed, ended): one row per stretch on sale.

    An item ends on the ``patience``-th complete day without it; seen again, it begins a new episode.
    ``missed`` are the complete days missed since it was last seen, at most ``patience``; ``ended`` is null for items
    on sale. Sightings on incomplete days count, absences don't. Sightings on days without a run are left out;
    repeated sightings count once.

    A scope's days are few; sightings meet them by (scope, date), and the two windows share one shuffle by key.
    """
    places = _places(days, scope, date)
    per_scope = Window.partitionBy(*scope)
    # the day on which the n-th complete day lies
    nth = places.where("ok").select(*scope, F.col("_place").alias("_end_place"), F.col(date).alias("ended"))
    seen = sightings.where(F.col(key).isNotNull()).select(*scope, key, date).distinct()
    at = seen.join(places.withColumn("_all", F.max("_place").over(per_scope)), [*scope, date])
    w = Window.partitionBy(*scope, key).orderBy(date)
    # complete days strictly between this sighting and the next (or the last day)
    next_place = F.lead(F.col("_place") - F.col("ok").cast("int")).over(w)
    gap = at.withColumn("_missed", F.coalesce(next_place, F.col("_all")) - F.col("_place"))
    fresh = gap.withColumn("episode", F.count_if(F.col("_missed") >= patience).over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1)
    last = fresh.groupBy(*scope, key, "episode").agg(F.min(date).alias("started"), F.max(date).alias("last_seen"), F.max_by("_missed", date).alias("_m"), F.max("_place").alias("_p"))
    closed = last.withColumn("_end_place", F.when(F.col("_m") >= patience, F.col("_p") + patience)).join(nth, [*scope, "_end_place"], "left")
    return closed.select(*scope, key, F.col("episode").cast("int").alias("episode"), "started", "last_seen", F.least("_m", F.lit(patience)).cast("int").alias("missed"), "ended")


def state(found: DataFrame, *, scope: Sequence[str] = ("chain",), key: str = "product_id") -> DataFrame:
    """(scope, key, status, missed, first_seen, last_seen, ended, relaunches): the present state, from :func:`episodes`."""
    last = F.max_by(F.struct("missed", "last_seen", "ended"), "episode")
    by = found.groupBy(*scope, key).agg(F.min("started").alias("first_seen"), (F.max("episode") - 1).alias("relaunches"), last.alias("_l"))
    return by.select(*scope, key, F.when(F.col("_l.ended").isNull(), "on_sale").otherwise("ended").alias("status"), "_l.missed", "first_seen", "_l.last_seen", "_l.ended", "relaunches")


def changes(rows: DataFrame, *, keys: Sequence[str], at: str, value: str, period: Column | None = None) -> DataFrame:
    """(keys, at, old, new): observations whose value differs from the last known one. Null values say nothing; the first
    capture has a null ``old``. One row per (keys, at) is expected.

    With ``period``, which has to grow with ``at``, rows are compared within (key, period), so a key with a long history is spread over its
    periods; what was known before a period comes from one row for each of the earlier ones.
    """
    told = rows.where(F.col(value).isNotNull())
    if period is None:
        known = told.withColumn("_old", F.lag(value).over(Window.partitionBy(*keys).orderBy(at)))
    else:
        told = told.select(F.struct(*keys).alias("_key"), F.coalesce(period, F.lit(0)).alias("_period"), F.col(at), F.col(value)).repartition("_key", "_period")
        last = told.groupBy("_key", "_period").agg(F.max_by(value, at).alias("_last"))
        before = last.select("_key", "_period", F.lag("_last").over(Window.partitionBy("_key").orderBy("_period")).alias("_before"))
        own = told.withColumn("_own", F.lag(value).over(Window.partitionBy("_key", "_period").orderBy(at)))
        known = own.join(before, ["_key", "_period"]).select(*(F.col(f"_key.{k}") for k in keys), at, value, F.coalesce("_own", "_before").alias("_old"))
    return known.where(F.col("_old").isNull() | (F.col("_old") != F.col(value))).select(*keys, at, F.col("_old").alias("old"), F.col(value).alias("new"))


def streaks(days: DataFrame, *, keys: Sequence[str], date: str, bad: str) -> DataFrame:
    """(keys, started, ended, length): runs of consecutive calendar days with ``bad`` true; a day counts once."""
    hit = days.where(F.col(bad)).select(*keys, F.to_date(date).alias("_d")).distinct()
    w = Window.partitionBy(*keys).orderBy("_d")
    marked = hit.withColumn("_g", F.date_sub("_d", F.row_number().over(w)))
    return marked.groupBy(*keys, "_g").agg(F.min("_d").alias("started"), F.max("_d").alias("ended"), F.count(F.lit(1)).alias("length")).drop("_g")


def run_streaks(runs: DataFrame, *, keys: Sequence[str], order: Sequence[str], bad: Column, least: int = 3) -> DataFrame:
    """(keys, first, last, length): at least ``least`` bad runs in a row, whatever the dates between them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = runs.withColumns({"_bad": F.coalesce(bad, F.lit(False)), "_n": F.row_number().over(w)})
    island = marked.withColumn("_g", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = island.where("_bad").groupBy(*keys, "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count(F.lit(1)).alias("length"))
    return found.where(F.col("length") >= least).drop("_g")


def burst_limit(n: Column, floor: int = 10, share: float = 0.25) -> Column:
    """How many unknown items a run of ``n`` may bring; more are held back."""
    return F.greatest(F.lit(floor), F.floor(n * share).cast("int"))


def holds(counts: DataFrame, *, keys: Sequence[str], date: str, total: str, unknown: str, escalate: int = 3, floor: int = 10, share: float = 0.25) -> DataFrame:
    """(keys, date, total, unknown, limit, held, hold_days, escalated): runs with more unknown items than the limit are held.

    ``hold_days`` counts the held runs since the last run that wasn't; gaps between dates don't reset it. A
    scope's first run is exempt. From ``escalate`` held runs on the hold is passed on.
    """
    w = Window.partitionBy(*keys).orderBy(date)
    limit = burst_limit(F.col(total), floor, share)
    judged = counts.withColumns({"limit": limit, "held": (F.col(unknown) > limit) & (F.row_number().over(w) > 1)})
    judged = judged.withColumn("_g", F.sum((~F.col("held")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w2 = Window.partitionBy(*keys, "_g").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("hold_days", F.when(F.col("held"), F.sum(F.col("held").cast("int")).over(w2)).otherwise(0))
    return judged.select(*keys, date, total, unknown, "limit", "held", F.col("hold_days").cast("int").alias("hold_days"), (F.col("hold_days") >= escalate).alias("escalated"))


def held_rows(rows: DataFrame, judged: DataFrame, known: DataFrame, *, keys: Sequence[str], date: str, key: str) -> DataFrame:
    """The rows of every run as far as they may be applied, with ``list_ok``: a held run (see :func:`holds`) keeps its known items only."""
    gate = judged.select(*keys, date, (~F.col("held")).alias("list_ok"))
    told = rows.join(gate, [*keys, date]).join(known.select(*keys, key).distinct().withColumn("_known", F.lit(True)), [*keys, key], "left")
    return told.where(F.col("list_ok") | F.col("_known").isNotNull()).drop("_known")


def ratio_guard(counts: DataFrame, *, keys: Sequence[str], date: str, n: str, ratio: float = 0.5) -> DataFrame:
    """(keys, date, n, previous, ok): a run with fewer than ``ratio`` times the items of the run before isn't ok."""
    w = Window.partitionBy(*keys).orderBy(date)
    seen = counts.withColumn("previous", F.lag(n).over(w))
    return seen.select(*keys, date, n, "previous", F.coalesce(F.col(n) >= F.col("previous") * ratio, F.lit(True)).alias("ok"))
