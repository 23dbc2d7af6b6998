"""Keyed merging: many listing rows to one, today's rows against stored ones, baselines, budgets, moves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_told(c: str, order: Sequence[str]) -> Column:
    """The first non-null value by ``order``."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))


def merge_pages(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str], flags: Sequence[str] = (), firsts: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """One row per key of a listing that shows items on several pages: flags are or-ed, other columns take their first told
    value in listing order, arrays become the sorted set of all values. Reduced in the map tasks but for the sets,
    whose values are distinct per key."""
    return rows.groupBy(*keys).agg(
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags),
        *(first_told(c, order).alias(c) for c in firsts),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets),
    )


def upsert(stored: DataFrame, today: DataFrame, *, keys: Sequence[str], update: Mapping[str, Column], absent_counts: Column | None = None) -> DataFrame:
    """Stored rows against today's by a full outer join on ``keys``: (keys, columns of ``update``, action).

    ``action``: ``update`` where both have the key, ``insert`` for new ones, ``missing`` for stored ones that today
    lacks - ``keep`` instead where ``absent_counts`` is false (an incomplete run). ``update`` sees stored columns as
    ``s.x`` and today's as ``t.x``.
    """
    s, t = stored.withColumn("_in_s", F.lit(True)).alias("s"), today.withColumn("_in_t", F.lit(True)).alias("t")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"s.{k}") == F.col(f"t.{k}")
    in_s, in_t = F.col("s._in_s").isNotNull(), F.col("t._in_t").isNotNull()
    action = F.when(in_s & in_t, "update").when(in_t, "insert").when(absent_counts if absent_counts is not None else F.lit(True), "missing").otherwise("keep")
    return s.join(t, on, "full_outer").select(*(F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in keys), *(c.alias(n) for n, c in update.items()), action.alias("action"))


def new_against(rows: DataFrame, baseline: DataFrame, *, scope: Sequence[str], key: str) -> DataFrame:
    """Rows whose key the scope's baseline lacks; a scope without any baseline has nothing new."""
    known = baseline.select(*scope).distinct()
    return rows.join(known, [*scope], "left_semi").join(baseline.select(*scope, key).distinct(), [*scope, key], "left_anti")


def classify(limited: Column, badge: Column, in_news: Column, new: Column) -> Column:
    """``limited`` by any sign of it, else ``new`` against the baseline, else ``regular``; unknown signs count as no."""
    sign = F.coalesce(limited, F.lit(False)) | F.coalesce(badge, F.lit(False)) | F.coalesce(in_news, F.lit(False))
    return F.when(sign, "limited").when(F.coalesce(new, F.lit(False)), "new").otherwise("regular")


def budget(rows: DataFrame, *, scope: Sequence[str], order: Sequence[Column | str], limit: int, name: str = "within") -> DataFrame:
    """Rows with ``within``: among the first ``limit`` of their scope by ``order``. Ranks are cut by the window group limit
    where only the first ones are kept, so a large scope isn't sorted as a whole in one task."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) <= limit)


def top_by(rows: DataFrame, *, scope: Sequence[str], order: Sequence[Column | str], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each scope with their rank; cut in the map tasks before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col(rank) <= limit)


def mutual_moves(gone: DataFrame, fresh: DataFrame, *, by: Sequence[str], key: str) -> DataFrame:
    """(by, old, new): a vanished and a new key that share ``by`` - only where each side has exactly one."""
    one = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(name)).where("_n = 1").drop("_n")
    return one(gone, "old").join(one(fresh, "new"), [*by])


def merge_rekeyed(rows: DataFrame, *, keys: Sequence[str], born: str, seen: str, oldest: Sequence[str], newest: Sequence[str], unions: Sequence[str] = (), any_of: Sequence[str] = ()) -> DataFrame:
    """Records that turned out to be one: ``oldest`` columns from the first born, ``newest`` from the last seen (each the
    told value nearest), unions of arrays, any of flags."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("merged"),
        F.min(born).alias(born),
        F.max(seen).alias(seen),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(born, c))).alias(c) for c in oldest),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(seen, c))).alias(c) for c in newest),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in unions),
        *(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_of),
    )


def override(old: DataFrame, new: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Both sets; where a key is in both, the new row stands."""
    return old.join(new.select(*keys), [*keys], "left_anti").unionByName(new)


def dead_letters(pending: DataFrame, failed: DataFrame, done: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Pending failures after a run: new failures replace old ones of their key, successes remove them."""
    return override(pending, failed, keys=keys).join(done.select(*keys), [*keys], "left_anti")


def recheck_queue(products: DataFrame, listed: DataFrame, *, scope: Sequence[str], key: str, checked: str, today: Column, limit: Column | int) -> DataFrame:
    """(scope, key, rank): what to check again: on sale, listed today and not checked today, those never checked first, then by the day of the last
    check and key; at most ``limit`` of a scope (a number or a column of ``listed``)."""
    extra = [] if isinstance(limit, int) else [F.max(limit).alias("_limit")]
    known = listed.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("_"), *extra)
    open_ = products.where((F.col("status") == "on_sale") & ~F.coalesce(F.to_date(checked) == today, F.lit(False))).join(known, [*scope, key])
    ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.asc_nulls_first(checked), key)))
    return ranked.where(F.col("rank") <= (limit if isinstance(limit, int) else F.col("_limit"))).select(*scope, key, "rank")


def creations(fresh: DataFrame, failed: DataFrame, *, scope: Sequence[str], key: str, order: Sequence[str], limit: int) -> DataFrame:
    """(scope, key, outcome): of a run's new items the first ``limit`` in listing order are tried - ``created``, or ``failed`` where ``failed`` has
    them, which uses up the budget as well - and the rest is ``deferred``."""
    ranked = budget(fresh, scope=scope, order=[*order, key], limit=limit).join(failed.select(*scope, key).distinct().withColumn("_f", F.lit(True)), [*scope, key], "left")
    outcome = F.when(~F.col("within"), "deferred").when(F.col("_f"), "failed").otherwise("created")
    return ranked.select(*scope, key, outcome.alias("outcome"))


def migrate_keys(products: DataFrame, moves: DataFrame, *, scope: Sequence[str], key: str, born: str) -> DataFrame:
    """(scope, key, action, target): what a change of keys does to stored records: nothing is written, so this is also the dry run.

    ``moves`` maps (scope, old) to new. A record under an old key is ``rename``d; if the new key exists already the younger of the two
    is a false new: it is ``delete``d and the older one stands under the new key (``merge``). Other records ``keep`` their key. A second run over the outcome changes nothing.
    """
    p = products.select(*scope, F.col(key).alias("_k"), F.col(born).alias("_b"))
    m = moves.select(*scope, F.col("old").alias("_k"), F.col("new").alias("_new")).distinct()
    target = p.join(m, [*scope, "_k"], "left").withColumn("_t", F.coalesce("_new", "_k"))
    group = Window.partitionBy(*scope, "_t")
    ranked = target.withColumns({"_n": F.count(F.lit(1)).over(group), "_r": F.row_number().over(group.orderBy("_b", "_k"))})
    action = F.when(F.col("_r") > 1, "delete").when(F.col("_n") > 1, "merge").when(F.col("_t") != F.col("_k"), "rename").otherwise("keep")
    return ranked.select(*scope, F.col("_k").alias(key), action.alias("action"), F.col("_t").alias("target"))


def ended_within(status: Column, ended: Column, today: Column, days: int) -> Column:
    """Ended at most ``days`` before ``today``; false where the day isn't known."""
    return F.coalesce((status == "ended") & F.datediff(today, ended).between(0, days), F.lit(False))


def without(rows: DataFrame, *, name: str, words: str, category: str, categories: Sequence[str], price: str, least_price: int) -> DataFrame:
    """Rows but for those whose name has one of ``words`` (a pattern), of ``categories``, or with a price below ``least_price``; what is null doesn't exclude."""
    out = F.col(name).rlike(words), F.col(category).isin(*categories), F.col(price) < least_price
    keep = F.lit(True)
    for c in out:
        keep &= ~F.coalesce(c, F.lit(False))
    return rows.where(keep)


def told(c: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Whether a text has any of the words to include and none of those to exclude; false for null."""
    any_of = lambda words: F.coalesce(F.exists(F.array(*(F.contains(c, F.lit(w)) for w in words)), lambda x: x), F.lit(False)) if words else F.lit(False)
    return any_of(include) & ~any_of(exclude)
