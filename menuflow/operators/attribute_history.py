"""History of changing attributes, stored as checkpoints and patches.

Time is cut into periods. A *patch* says which attributes an observation set to
another value than the one known so far in its period; a *checkpoint* is the
full version of a key at the start of a period. Any version is rebuilt from the
checkpoint of its own period and the patches between it and the moment asked
for, so no key is ever folded from its beginning in one task: a key that holds a
third of all rows is spread over its periods.

Shuffles: one to reduce repeated observations (with a partial reduction before
it), one by (key, period) that everything about patches keeps (both the summaries and the
fold read that one exchange), and two of the per-period summaries, which have one row per (key, period).
Nothing runs while the plan is built. :func:`write_store` and :func:`read_store` keep the two tables as parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from menuflow.functions.plain import plain_form

FOUR_WEEKS = 28 * 86400


@dataclass
class HistoryStore:
    """patches: ``_key`` (a struct of the keys), ``_period``, ``at``, ``set_<attribute>`` (null: not set).
    checkpoints: ``_key``, ``_period``, ``start_<attribute>`` and ``_next``, the moment of the first change in a later period."""

    keys: list[str]
    attributes: list[str]
    period_seconds: int
    patches: DataFrame
    checkpoints: DataFrame


def _period(c: Column, seconds: int) -> Column:
    # never null, so that no join infers a filter for one of its sides and both read one exchange
    return F.coalesce(F.floor(F.unix_timestamp(c.cast("timestamp")) / seconds), F.lit(0))


def build_history(
    updates: DataFrame,
    *,
    keys: Sequence[str] = ("chain", "product_id"),
    attributes: Sequence[str] = ("price", "status"),
    plain: Sequence[str] = ("product_id", "status"),
    at: str = "observed_at",
    precedence: Sequence[str] = ("received_at", "update_id"),
    period_seconds: int = FOUR_WEEKS,
) -> HistoryStore:
    """Reduce observations to patches and checkpoints.

    Of observations of a key with equal ``at`` only the one with the greatest ``precedence`` (nulls
    lowest), then the greatest values, stands, as a whole. A null attribute says nothing. Rows without
    ``at`` or without the last key are left out; other columns are ignored.
    """
    keys, attributes = list(keys), list(attributes)
    values = {c: (plain_form(F.col(c)) if c in plain else F.col(c)) for c in (*keys, *attributes)}
    stands = (
        updates.where(F.col(at).isNotNull())
        .select(*(v.alias(c) for c, v in values.items()), F.col(at).alias("at"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(precedence)))
        .where(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != ""))
        .groupBy(F.struct(*keys).alias("_key"), "at")
        .agg(F.max(F.struct(*(F.col(f"_p{i}") for i in range(len(precedence))), F.struct(*attributes).alias("_v"))).alias("_m"))
        .select("_key", _period(F.col("at"), period_seconds).alias("_period"), "at", "_m._v.*")
        .repartition("_key", "_period")
    )
    in_period = Window.partitionBy("_key", "_period").orderBy("at")
    before = in_period.rowsBetween(Window.unboundedPreceding, -1)
    known = stands.withColumns({f"_was_{a}": F.last(a, ignorenulls=True).over(before) for a in attributes})
    sets = {f"set_{a}": F.when(F.col(a).isNotNull() & ~F.col(a).eqNullSafe(F.col(f"_was_{a}")), F.col(a)) for a in attributes}
    firsts = {f"_first_{a}": F.col(a).isNotNull() & F.col(f"_was_{a}").isNull() for a in attributes}
    any_set = F.coalesce(*(F.col(f"set_{a}").cast("string") for a in attributes)).isNotNull()
    patches = known.select("_key", "_period", "at", *(v.alias(c) for c, v in (sets | firsts).items())).where(any_set)

    summary: list[Column] = []
    for a in attributes:
        given, first = F.col(f"set_{a}").isNotNull(), F.col(f"_first_{a}")
        summary += [
            F.max_by(f"set_{a}", F.when(given, F.col("at"))).alias(f"_last_{a}"),
            F.max(F.when(first, F.col(f"set_{a}"))).alias(f"_head_{a}"),
            F.min(F.when(first, F.col("at"))).alias(f"_head_at_{a}"),
            F.min(F.when(given & ~first, F.col("at"))).alias(f"_more_at_{a}"),
        ]
    by_key = Window.partitionBy("_key").orderBy("_period")
    earlier, later = by_key.rowsBetween(Window.unboundedPreceding, -1), by_key.rowsBetween(1, Window.unboundedFollowing)
    moments = [F.when(F.col(f"_head_{a}").isNotNull() & ~F.col(f"_head_{a}").eqNullSafe(F.col(f"start_{a}")), F.col(f"_head_at_{a}")) for a in attributes]
    moments += [F.col(f"_more_at_{a}") for a in attributes]
    checkpoints = (
        patches.groupBy("_key", "_period")
        .agg(*summary)
        .withColumns({f"start_{a}": F.last(f"_last_{a}", ignorenulls=True).over(earlier) for a in attributes})
        .withColumn("_change", F.least(*moments) if len(moments) > 1 else moments[0])
        .withColumn("_next", F.min("_change").over(later))
        .select("_key", "_period", *(f"start_{a}" for a in attributes), "_next")
    )
    return HistoryStore(keys, attributes, period_seconds, patches.select("_key", "_period", "at", *sets), checkpoints)


def write_store(store: HistoryStore, path: str) -> HistoryStore:
    """Writes both tables below ``path`` and gives the store that reads them (see :func:`read_store`)."""
    store.patches.write.mode("overwrite").parquet(f"{path}/patches")
    store.checkpoints.write.mode("overwrite").parquet(f"{path}/checkpoints")
    return read_store(store.patches.sparkSession, path, store.keys, store.attributes, store.period_seconds)


def read_store(spark: SparkSession, path: str, keys: Sequence[str], attributes: Sequence[str], period_seconds: int) -> HistoryStore:
    """A store written by :func:`write_store`; its keys, attributes and period have to be the same."""
    return HistoryStore(list(keys), list(attributes), period_seconds, spark.read.parquet(f"{path}/patches"), spark.read.parquet(f"{path}/checkpoints"))


def versions(store: HistoryStore) -> DataFrame:
    """(keys, valid_from, valid_to, attributes): every version, folded forward from the checkpoint of its period.

    ``valid_to`` is the next version's ``valid_from``, null for the last. An attribute nobody told yet is
    null. Keys that never told any attribute have no version. Empty input gives no rows.
    """
    keys, attributes = store.keys, store.attributes
    joined = store.patches.join(store.checkpoints, ["_key", "_period"])
    w = Window.partitionBy("_key", "_period").orderBy("at")
    now, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    state = {f"_now_{a}": F.coalesce(F.last(f"set_{a}", ignorenulls=True).over(now), F.col(f"start_{a}")) for a in attributes}
    past = {f"_was_{a}": F.coalesce(F.last(f"set_{a}", ignorenulls=True).over(before), F.col(f"start_{a}")) for a in attributes}
    differs = F.lit(False)
    for a in attributes:
        differs |= ~F.col(f"_now_{a}").eqNullSafe(F.col(f"_was_{a}"))
    return (
        joined.withColumns(state | past)
        .where(differs)
        .withColumn("valid_to", F.coalesce(F.lead("at").over(w), F.col("_next")))
        .select(*(F.col(f"_key.{k}") for k in keys), F.col("at").alias("valid_from"), "valid_to", *(F.col(f"_now_{a}").alias(a) for a in attributes))
    )


def as_of(store: HistoryStore, moment: str) -> DataFrame:
    """(keys, attributes): the version of every key at ``moment``.

    The nearest checkpoint at or before it is the start of the key's last period not after it; only the patches of
    that period up to the moment are folded, by one aggregate, whatever the length of the history.
    Keys without any told attribute by then have no row.
    """
    keys, attributes = store.keys, store.attributes
    asked = F.lit(moment).cast("timestamp_ntz")
    limit = _period(asked, store.period_seconds)
    nearest = (
        store.checkpoints.where(F.col("_period") <= limit)
        .groupBy("_key")
        .agg(F.max_by(F.struct("_period", *(F.col(f"start_{a}") for a in attributes)), "_period").alias("_c"))
        .select("_key", "_c.*")
    )
    folded = (
        store.patches.where((F.col("_period") <= limit) & (F.col("at") <= asked))
        .groupBy("_key", "_period")
        .agg(*(F.max_by(f"set_{a}", F.when(F.col(f"set_{a}").isNotNull(), F.col("at"))).alias(f"set_{a}") for a in attributes))
    )
    out = nearest.join(folded, ["_key", "_period"], "left").select(*(F.col(f"_key.{k}") for k in keys), *(F.coalesce(F.col(f"set_{a}"), F.col(f"start_{a}")).alias(a) for a in attributes))
    return out.where(F.coalesce(*(F.col(a).cast("string") for a in attributes)).isNotNull())
