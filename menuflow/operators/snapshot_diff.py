"""What changed between consecutive full snapshots, by signed cells.

Every row of a snapshot is unpivoted into one presence marker and one cell per
compared field. A cell counts +1 in the difference that its own snapshot gives
and -1 in the difference that the following snapshot gives, so one grouped sum
over (key, snapshot, field, value) leaves nonzero exactly the cells that differ.
No snapshot is ever joined with another one.

Shuffles: one to reduce each (key, snapshot) to the row that counts - after a
partial reduction in the map tasks, so repeated rows never travel - and one that
brings the slim reduced rows together by key. Unpivoting, the grouped sums and
the classification keep that second partitioning. No task holds more than the
sums of its own keys; a hot scope (chain) spreads over its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuflow.functions.plain import plain_form

PRESENCE = ""


def accepted_runs(runs: DataFrame, scope: Sequence[str] = ("chain",), date: str = "run_date", seq: str = "run_seq", ok: str = "ok") -> DataFrame:
    """(scope, date, seq, next_date, is_first): of each scope and date the highest ``seq`` with ``ok`` true.

    Runs with a null scope, date or seq can't be told apart and are left out.
    """
    known = F.lit(True)
    for c in (*scope, date, seq):
        known &= F.col(c).isNotNull()
    w = Window.partitionBy(*scope).orderBy(date)
    return (
        runs.where(F.col(ok) & known)
        .groupBy(*scope, date)
        .agg(F.max(seq).alias(seq))
        .withColumns({"next_date": F.lead(date).over(w), "is_first": F.lag(date).over(w).isNull()})
    )


def _order(c: Column) -> Column:
    return F.struct(c.isNull(), c)


def diff_snapshots(
    rows: DataFrame,
    runs: DataFrame,
    *,
    scope: Sequence[str] = ("chain",),
    key: str = "product_id",
    fields: Sequence[str] = ("price", "status"),
    plain: Sequence[str] = ("product_id", "status"),
    order: Sequence[str] = ("page_ord", "card_ord"),
    date: str = "run_date",
    seq: str = "run_seq",
    ok: str = "ok",
) -> DataFrame:
    """(scope, key, date, change, fields): one row per key that came, went or changed against the scope's previous snapshot.

    ``change`` is ``added``, ``removed`` or ``changed``; ``fields`` names the changed fields, sorted
    and joined by commas (empty for added and removed). ``runs`` says which delivery is the snapshot of a
    date, see :func:`accepted_runs`; a snapshot without any row removes every key. The first snapshot of a
    scope gives no rows.

    Defined results: rows with a null or blank key or of no accepted run don't count; of several rows of a
    key the one with the smallest ``order`` (nulls last) counts, then the one with the smallest values, so
    repeated rows and ties have one result; a null field is a value of its own; an empty table gives no
    rows; other columns are ignored.
    """
    snapshots = accepted_runs(runs, scope, date, seq, ok)
    values = {c: (plain_form(F.col(c)) if c in plain else F.col(c)) for c in (key, *fields)}
    picked = (
        rows.select(*scope, F.col(date), F.col(seq), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *(v.alias(c) for c, v in values.items()))
        .where(F.col(key).isNotNull() & (F.col(key) != ""))
        .join(snapshots, [*scope, date, seq])
        .groupBy(*scope, key, date, "next_date", "is_first")
        .agg(F.min(F.struct(*(_order(F.col(f"_o{i}")) for i in range(len(order))), F.struct(*(F.col(c) for c in fields)).alias("_v"))).alias("_best"))
        .select(*scope, key, date, "next_date", "is_first", "_best._v.*")
        .repartition(*scope, key)
    )

    def cells(sign: int, at: str) -> list[Column]:
        head = [F.col(at).alias("_at"), F.lit(sign).alias("_sign")]
        marker = F.struct(*head, F.lit(PRESENCE).alias("_field"), F.lit(None).cast("string").alias("_value"))
        return [marker, *(F.struct(*head, F.lit(c).alias("_field"), F.col(c).cast("string").alias("_value")) for c in fields)]

    own, after = F.array(*cells(1, date)), F.array(*cells(-1, "next_date"))
    nothing = F.filter(own, lambda _: F.lit(False))
    signed = F.concat(F.when(F.col("is_first"), nothing).otherwise(own), F.when(F.col("next_date").isNull(), nothing).otherwise(after))
    sums = picked.select(*scope, key, F.inline(signed)).groupBy(*scope, key, "_at", "_field", "_value").agg(F.sum("_sign").alias("_sum")).where(F.col("_sum") != 0)
    presence = F.max(F.when(F.col("_field") == PRESENCE, F.col("_sum")))
    told = F.array_sort(F.collect_set(F.when(F.col("_field") != PRESENCE, F.col("_field"))))
    return (
        sums.groupBy(*scope, key, "_at")
        .agg(presence.alias("_presence"), told.alias("_fields"))
        .select(
            *scope,
            key,
            F.col("_at").alias(date),
            F.when(F.col("_presence") > 0, "added").when(F.col("_presence") < 0, "removed").otherwise("changed").alias("change"),
            F.when(F.col("_presence").isNull(), F.array_join("_fields", ",")).otherwise("").alias("fields"),
        )
    )
