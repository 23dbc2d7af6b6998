"""Gates: whether a whole run, source or version may be applied; joined as small tables, never collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def energy_ok(protein: Column, fat: Column, carbs: Column, kcal: Column, share: float = 0.15, least: float = 6.0) -> Column:
    """Whether energy fits the nutrients (4, 9 and 4 kcal a gram) within a share of it, at least ``least`` kcal; null where one is."""
    return F.abs(protein * 4 + fat * 9 + carbs * 4 - kcal) <= F.greatest(kcal * share, F.lit(least))


def source_gate(rows: DataFrame, *, keys: Sequence[str], ok: Column, complete: Column, rows_least: int = 80, pass_least: float = 0.8, complete_least: float = 0.8) -> DataFrame:
    """(keys, n, pass_rate, completeness, reason): why a source isn't accepted, null if it is: too few rows, too many that
    fail their check, too many incomplete ones."""
    by = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(ok, F.lit(False)).cast("int")), 6).alias("pass_rate"), F.round(F.avg(F.coalesce(complete, F.lit(False)).cast("int")), 6).alias("completeness")
    )
    reason = F.when(F.col("n") < rows_least, "few_rows").when(F.col("pass_rate") < pass_least, "pass_rate").when(F.col("completeness") < complete_least, "completeness")
    return by.withColumn("reason", reason)


def sources_to_read(sources: DataFrame, state: DataFrame, *, key: str, signature: str, checked: str, today: Column, every_days: int = 7) -> DataFrame:
    """(key, reason): sources whose signature changed, or that have none and weren't read for ``every_days``; signatures known to
    be bad are skipped."""
    s = state.select(F.col(key), F.col(signature).alias("_old"), F.col(checked).alias("_checked"), F.col("bad_signature").alias("_bad"))
    j = sources.join(s, key, "left")
    new, old = F.col(signature), F.col("_old")
    reason = F.when(new.isNotNull() & new.eqNullSafe(F.col("_bad")), None).when(new.isNotNull() & ~new.eqNullSafe(old), "changed").when(new.isNull() & (F.col("_checked").isNull() | (F.datediff(today, "_checked") >= every_days)), "unsigned")
    return j.select(key, reason.alias("reason")).where("reason is not null")


def version_upsert(stored: DataFrame, offered: DataFrame, *, key: str, version: str, values: Sequence[str]) -> DataFrame:
    """(key, version, values, action): offered values replace stored ones unless the version is the same; keys without an
    offer are kept."""
    s, o = stored.alias("s"), offered.alias("o")
    take = F.col(f"o.{key}").isNotNull() & ~F.col(f"o.{version}").eqNullSafe(F.col(f"s.{version}"))
    pick = lambda c: F.when(take, F.col(f"o.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    action = F.when(F.col(f"s.{key}").isNull(), "insert").when(take, "replace").otherwise("keep")
    return s.join(o, F.col(f"s.{key}") == F.col(f"o.{key}"), "full_outer").select(F.coalesce(f"s.{key}", f"o.{key}").alias(key), pick(version), *(pick(c) for c in values), action.alias("action"))


def abort_if_half_fail(checked: DataFrame, *, keys: Sequence[str], ok: str) -> DataFrame:
    """The rows of ``keys`` of which fewer than half fail; a batch of which half or more fail is dropped as a whole."""
    bad = checked.groupBy(*keys).agg(F.avg((~F.coalesce(F.col(ok), F.lit(False))).cast("double")).alias("_f")).where("_f >= 0.5").select(*keys)
    return checked.join(bad, [*keys], "left_anti").where(F.col(ok))


def update_run(heads: DataFrame, state: DataFrame, rows: DataFrame, *, key: str, signature: str, ok: Column, complete: Column, today: Column, rows_least: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows to apply, new state) of a run over sources: those whose signature changed (:func:`sources_to_read`) are read, judged as a whole
    (:func:`source_gate`), applied if they pass, and remembered - with their signature, or as bad so that they aren't tried again until it changes.

    ``heads`` has (key, signature), ``state`` (key, signature, checked, bad_signature), ``rows`` what was parsed of any source. Sources that
    weren't read keep their state; a read source without rows is bad.
    """
    due = sources_to_read(heads, state, key=key, signature=signature, checked="checked", today=today)
    read = due.join(heads, key)
    judged = source_gate(rows.join(read.select(key), key, "left_semi"), keys=[key], ok=ok, complete=complete, rows_least=rows_least)
    outcome = read.join(judged.select(key, F.col("reason").alias("_why"), F.lit(True).alias("_has")), key, "left").withColumn("good", F.col("_has").isNotNull() & F.col("_why").isNull())
    applied = rows.join(outcome.where("good").select(key), key, "left_semi")
    new = outcome.select(key, F.when(F.col("good"), F.col(signature)).alias(signature), today.alias("checked"), F.when(~F.col("good"), F.col(signature)).alias("bad_signature"))
    old = state.select(key, signature, "checked", "bad_signature").join(outcome.select(key), key, "left_anti")
    return applied, old.unionByName(new)
