"""Matching items with dated announcements and other texts: quotes, windows, containment, vetoes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menuflow.functions.text import runs


def in_window(date: Column, reference: Column, before: int, after: int) -> Column:
    """Within ``before`` days before and ``after`` days after the reference."""
    return date.between(F.date_sub(reference, before), F.date_add(reference, after))


def latest_in_window_binned(items: DataFrame, news: DataFrame, *, on: Sequence[str], reference: str, date: str, before: int, after: int, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Items with the latest announcement of their ``on`` columns within the window around ``reference``; ties by ``tie``.

    An equi-join on ``on`` and time bins as wide as the window, so that a hot ``on`` value is spread over
    its bins and an item only meets announcements of the bins its window touches; reduced by a grouped maximum in the map tasks."""
    width = before + after + 1
    bin_of = lambda c: F.floor(F.unix_date(c) / width)
    n = news.withColumn("_bin", bin_of(F.to_date(date))).select(*on, "_bin", date, *(F.col(c).alias(f"_t_{c}") for c in tie))
    spans = F.sequence(bin_of(F.date_sub(reference, before)), bin_of(F.date_add(reference, after)))
    i = items.select(*keys, *on, reference).withColumn("_bin", F.explode(spans))
    hit = i.join(n, [*on, "_bin"]).where(in_window(F.col(date), F.col(reference), before, after))
    best = hit.groupBy(*keys, *on, reference).agg(F.max(F.struct(date, *(f"_t_{c}" for c in tie))).alias("_b"))
    return best.select(*keys, *on, reference, F.col(f"_b.{date}").alias(date), *(F.col(f"_b._t_{c}").alias(c) for c in tie))


def contained_in(names: DataFrame, texts: DataFrame, *, name: str, text: str, name_keys: Sequence[str], text_keys: Sequence[str], block: int = 6) -> DataFrame:
    """(name_keys, text_keys): texts that contain a name of at least ``block`` signs, as an equi-join.

    Texts give every run of ``block`` signs once, names their first one; a common run is a candidate, which is then
    held against the whole name. Candidates grow with true beginnings, not with names times texts. Only keys and runs travel;
    runs that no name begins with are dropped by the join, and the texts are joined back by key for the candidates.
    """
    heads = names.where(F.length(name) >= block).select(*name_keys, F.col(name).alias("_name"), F.substring(F.col(name), 1, block).alias("_run"))
    found = texts.select(*text_keys, F.explode(runs(F.col(text), block)).alias("_run")).join(heads, "_run").select(*name_keys, "_name", *text_keys)
    whole = texts.select(*text_keys, F.col(text).alias("_text"))
    return found.join(whole, [*text_keys]).where(F.contains("_text", "_name")).select(*name_keys, *text_keys).distinct()


def quoted_matches(items: DataFrame, news: DataFrame, *, name: str, quotes: Column, item_keys: Sequence[str], news_keys: Sequence[str]) -> DataFrame:
    """(item_keys, news_keys): news that quote exactly an item's name; quotes are exploded, so this is a hash join."""
    q = news.select(*news_keys, F.explode(F.array_distinct(quotes)).alias("_q"))
    return q.join(items.select(*item_keys, F.col(name).alias("_q")), "_q").select(*item_keys, *news_keys).distinct()


def unique_end(items: DataFrame, events: DataFrame, *, on: Sequence[str], keys: Sequence[str], reference: str, end: str, is_open: Column, event_id: str) -> DataFrame:
    """(keys, end, event): the end that announcements agree on: no open event of the same name, and exactly one distinct
    end not before the reference; the greatest event id stands for it."""
    closed = items.join(events.where(is_open).select(*on).distinct(), [*on], "left_anti")
    told = closed.select(*keys, *on, reference).join(events.where(~is_open).select(*on, F.col(end).alias("_end"), F.col(event_id).alias("_id")), [*on]).where(F.col("_end") >= F.col(reference))
    by = told.groupBy(*keys).agg(F.count_distinct("_end").alias("_n"), F.max_by("_end", "_id").alias("end"), F.max("_id").alias("event"))
    return by.where("_n = 1").drop("_n")


def unless_ambiguous(items: DataFrame, rows: DataFrame, *, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Items joined with the values of their key, only where all rows of the key agree in all ``values``."""
    signature = F.struct(*values)
    by = rows.groupBy(*on).agg(F.min(signature).alias("_a"), F.max(signature).alias("_b")).where(F.col("_a").eqNullSafe(F.col("_b"))).select(*on, "_a.*")
    return items.join(by, [*on])


def siblings(items: DataFrame, *, group: Sequence[str], key: str) -> DataFrame:
    """(group, n, keys): groups of more than one item with the same name, their keys sorted."""
    by = items.groupBy(*group).agg(F.count_distinct(key).alias("n"), F.array_sort(F.collect_set(key)).alias("keys"))
    return by.where("n > 1")


def nearest(items: DataFrame, *, scope: Sequence[str], value: str, key: str, k: int, per_bin: int = 50_000, bins: int = 256) -> DataFrame:
    """(scope, key, near, distance, rank): for each item its ``k`` nearest of the scope by ``value``, ties by key.

    Equal values share their list. Of each distinct value the k + 1 smallest keys are kept (one may be the item itself), so the k nearest
    of a value stand among those of the value and of the k distinct values before and after it, however many items are
    equal: two windows over the distinct values give all candidates, and no other pair is formed. A scope is cut at approximate quantiles into
    bins of about ``per_bin`` distinct values (at most ``bins``), so that a hot one isn't sorted in one task; each bin borrows the k values before and after it,
    which are at most 2 x bins x k rows a scope. Where a value is null the distance is null and comes last: such items fill
    up lists that are short of others, and their own is the smallest keys. Items with a null key are left out.
    """
    told = items.where(F.col(key).isNotNull()).select(*scope, F.col(key).alias("_k"), F.col(value).alias("_v"))

    def smallest(rows: DataFrame, *by: str) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_k"))).where(F.col("_r") <= k + 1)
        return ranked.groupBy(*by).agg(F.array_sort(F.collect_list("_k")).alias("_ks"))

    tops = smallest(told, *scope, "_v")
    values = tops.where(F.col("_v").isNotNull())
    cuts = values.groupBy(*scope).agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)] or [0.5], 1000).alias("_q"), F.least(F.lit(bins), F.ceil(F.count(F.lit(1)) / per_bin)).cast("int").alias("_nb"))
    place = F.floor(F.size(F.filter("_q", lambda q: q < F.col("_v"))) * F.col("_nb") / bins).cast("int")
    binned = values.join(cuts, [*scope]).withColumn("_bin", F.least(place, F.col("_nb") - 1)).select(*scope, "_bin", "_nb", "_v", "_ks")

    def edge(ascending: bool) -> DataFrame:
        order = F.asc("_v") if ascending else F.desc("_v")
        first = binned.withColumn("_r", F.row_number().over(Window.partitionBy(*scope, "_bin").orderBy(order))).where(F.col("_r") <= k).drop("_r")
        others = F.sequence(F.lit(0), F.col("_bin") - 1) if ascending else F.sequence(F.col("_bin") + 1, F.col("_nb") - 1)
        has = (F.col("_bin") > 0) if ascending else (F.col("_bin") < F.col("_nb") - 1)
        lent = first.where(has).withColumn("_bin", F.explode(others))
        return lent.withColumn("_r", F.row_number().over(Window.partitionBy(*scope, "_bin").orderBy(order))).where(F.col("_r") <= k).drop("_r")

    lent = edge(True).unionByName(edge(False)).withColumn("_own", F.lit(False))
    rows = binned.withColumn("_own", F.lit(True)).unionByName(lent)
    w = Window.partitionBy(*scope, "_bin").orderBy("_v")
    near = [F.struct("_v", "_ks"), *(F.struct(f("_v", i).over(w).alias("_v"), f("_ks", i).over(w).alias("_ks")) for f in (F.lag, F.lead) for i in range(1, k + 1))]
    listed = rows.select(*scope, "_own", "_v", F.filter(F.array(*near), lambda x: x["_v"].isNotNull()).alias("_n")).where("_own")
    pairs = F.flatten(F.transform("_n", lambda x: F.transform(x["_ks"], lambda y: F.struct(F.abs(x["_v"] - F.col("_v")).alias("distance"), y.alias("near")))))
    best = listed.select(*scope, "_v", F.slice(F.array_sort(pairs), 1, k + 1).alias("_c"))
    kind = best.schema["_c"].dataType.elementType["distance"].dataType
    apart = lambda c: F.transform(c, lambda y: F.struct(F.lit(None).cast(kind).alias("distance"), y.alias("near")))
    untold = tops.where(F.col("_v").isNull()).select(*scope, F.col("_ks").alias("_rest"))
    filled = best.join(untold, [*scope], "left").select(*scope, "_v", F.when(F.col("_rest").isNull() | (F.size("_c") > k), F.col("_c")).otherwise(F.concat("_c", apart("_rest"))).alias("_c"))
    nulls = smallest(told.join(untold.select(*scope), [*scope], "left_semi"), *scope).withColumn("_v", F.lit(None).cast(told.schema["_v"].dataType)).select(*scope, "_v", apart("_ks").alias("_c"))
    lists = filled.unionByName(nulls).withColumnsRenamed({c: f"_s_{c}" for c in scope}).withColumnRenamed("_v", "_w")
    met = told.join(lists, [*(F.col(c) == F.col(f"_s_{c}") for c in scope), F.col("_v").eqNullSafe(F.col("_w"))])
    ranked = F.slice(F.filter("_c", lambda x: x["near"] != F.col("_k")), 1, k)
    return met.select(*scope, F.col("_k").alias(key), F.posexplode(ranked).alias("_p", "_x")).select(*scope, key, "_x.near", "_x.distance", (F.col("_p") + 1).alias("rank"))


def related(items: DataFrame, *, scope: Sequence[str], group: str, value: str, key: str, k: int) -> DataFrame:
    """(scope, key, near, rank): the ``k`` items of the scope to show beside each: those of its own group first, then by distance of ``value`` (null last) and key.

    Of the group the k nearest are enough; if it has fewer, the 2k nearest of the scope hold k of other groups, so the union of both lists is exact. Items without a group have
    nothing in common with each other.
    """
    told = items.where(F.col(group).isNotNull())
    own = nearest(told, scope=[*scope, group], value=value, key=key, k=k).select(*scope, key, "near", "distance", F.lit(0).alias("_far"))
    groups = items.select(*scope, F.col(key).alias("_k"), F.col(group).alias("_g")).distinct()
    wide = nearest(items, scope=scope, value=value, key=key, k=2 * k).select(*scope, key, "near", "distance")
    other = (
        wide.join(groups.withColumnsRenamed({"_k": key, "_g": "_a"}), [*scope, key])
        .join(groups.withColumnsRenamed({"_k": "near", "_g": "_b"}), [*scope, "near"])
        .where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
        .select(*scope, key, "near", "distance", F.lit(1).alias("_far"))
    )
    order = Window.partitionBy(*scope, key).orderBy("_far", F.asc_nulls_last("distance"), "near")
    return own.unionByName(other).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*scope, key, "near", "rank")


def distinguishing(rows: DataFrame, *, group: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(group, n, label): the first of ``labels`` that is told for every row of the group and differs for all; null if none."""
    n = F.count(F.lit(1))
    pick = F.coalesce(*(F.when((F.count(c) == n) & (F.count_distinct(c) == n), F.lit(c)) for c in labels))
    return rows.groupBy(*group).agg(n.alias("n"), pick.alias("label")).where("n > 1")


def quote_keys(title: Column, split: str | None = None, drop_brackets: bool = False) -> Column:
    """The quoted names of a title, also split on a sign and without what stands in brackets, each once."""
    from menuflow.functions.text import quotes

    found = quotes(title)
    if drop_brackets:
        found = F.concat(found, F.transform(found, lambda q: F.regexp_replace(q, r"[（(][^）)]*[）)]", "")))
    if split:
        found = F.concat(found, F.flatten(F.transform(found, lambda q: F.split(q, split))))
    return F.array_distinct(F.filter(found, lambda q: F.length(q) >= 2))


def _named(items: DataFrame, scope: Sequence[str], key: str, name: Column, reference: str) -> DataFrame:
    return items.select(*scope, key, name.alias("_name"), F.col(reference).alias("_ref"))


def _keyed(named: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, _name, _ref, _k): each name and reference of a scope once, however many items have them."""
    from menuflow.functions.text import match_key

    return named.select(*scope, "_name", "_ref").distinct().withColumn("_k", match_key(F.col("_name")))


def _holding(names: DataFrame, texts: DataFrame, scope: Sequence[str], least: int) -> DataFrame:
    """The rows of ``texts`` with each distinct name ``_k`` of at least ``least`` signs that their text ``_t`` contains, blocked by the name's first signs. Runs travel
    with a hash of their text, which is held against the whole name afterwards.

    The joins are never broadcast by the size of files: a well packed table is small there and large in memory."""
    heads = names.where(F.length("_k") >= least).select(*scope, "_k").distinct().withColumn("_run", F.substring("_k", 1, least))
    marked = texts.withColumn("_h", F.xxhash64("_t"))
    parts = marked.select(*scope, "_h", F.explode(runs(F.col("_t"), least)).alias("_run"))
    met = parts.join(heads.hint("merge"), [*scope, "_run"]).select(*scope, "_h", "_k").distinct()
    return marked.join(met.hint("merge"), [*scope, "_h"]).where(F.contains("_t", "_k")).drop("_h")


def _of_items(named: DataFrame, near: DataFrame, scope: Sequence[str], key: str, *columns: str) -> DataFrame:
    """(scope, key, columns): what was found for the name and reference of each item; the greatest of several."""
    met = named.join(near.select(*scope, "_name", "_ref", *columns).hint("merge"), [*scope, "_name", "_ref"])
    return met.groupBy(*scope, key).agg(F.max(F.struct(*columns)).alias("_b")).select(*scope, key, *(f"_b.{c}" for c in columns))


def launches(
    items: DataFrame,
    news: DataFrame,
    *,
    scope: Sequence[str],
    key: str,
    name: Column,
    reference: str,
    title: str,
    date: str,
    before: int = 120,
    after: int = 14,
    words: str,
    no_words: str,
    split: str | None = None,
    drop_brackets: bool = False,
    least: int = 4,
    strict: int | None = None,
    need_day: bool = True,
) -> DataFrame:
    """(scope, key, date, title, launch): the latest announcement within the window that names the item.

    An announcement counts if it has a launch word and none of the others. It names an item if a quoted text has the item's
    key (an equi-join of exploded quotes) or, without any quotes, if it contains a name of at least ``least`` signs (blocked by
    the name's first signs). With ``strict`` only quotes count that a launch word follows within so many signs. ``launch`` is the day the headline tells, near the
    announcement's; with ``need_day`` announcements without one don't count, so an earlier one that tells it stands. Ties go to the greatest title.
    Distinct names meet days with the greatest announcement of each, and items get what their name and reference met: no pairs of items and announcements.
    """
    from menuflow.functions.dates import headline_date
    from menuflow.functions.text import launch_quotes, match_key

    told = news.where(F.col(title).rlike(words) & ~F.col(title).rlike(no_words)).select(*scope, F.col(date).alias("date"), F.col(title).alias("title")).distinct()
    found = launch_quotes(F.col("title"), words, strict) if strict is not None else quote_keys(F.col("title"), split, drop_brackets)
    told = told.withColumns({"_q": found, "launch": headline_date(F.col("title"), F.col("date"))})
    if need_day:
        told = told.where("launch is not null")
    named = _named(items, scope, key, name, reference)
    names = _keyed(named, scope).where(F.col("_k") != "")
    columns = [*scope, "_k", "date", "title", "launch"]
    hit = told.withColumn("_k", F.explode("_q")).withColumn("_k", match_key(F.col("_k"))).select(*columns)
    if strict is None:
        loose = told.where(F.size("_q") == 0).withColumn("_t", match_key(F.col("title")))
        hit = hit.unionByName(_holding(names, loose, scope, least).select(*columns))
    # of a name's announcements of a day the greatest stands for all
    days = hit.groupBy(*scope, "_k", "date").agg(F.max(F.struct("title", "launch")).alias("_b")).select(*scope, "_k", "date", "_b.*")
    near = latest_in_window_binned(names, days.hint("merge"), on=[*scope, "_k"], reference="_ref", date="date", before=before, after=after, keys=["_name"], tie=["title", "launch"])
    return _of_items(named, near, scope, key, "date", "title", "launch")


def body_launches(items: DataFrame, articles: DataFrame, found: DataFrame, *, scope: Sequence[str], key: str, name: Column, reference: str, body: str, date: str, before: int = 14, after: int = 7, words: str, least: int = 4) -> DataFrame:
    """(scope, key, date): for items that :func:`launches` didn't find, the latest article of a narrower window whose body has a launch word and
    contains the item's name of at least ``least`` signs. Distinct names meet distinct bodies by the name's first signs, names meet days and items
    meet their name's result, so equal names and bodies are no pairs of rows."""
    from menuflow.functions.text import match_key

    # the names of all items, so that what found is made of isn't planned twice
    names = _keyed(_named(items, scope, key, name, reference), scope).where(F.length("_k") >= least)
    told = articles.where(F.col(body).rlike(words)).select(*scope, F.col(date).alias("date"), F.col(body).alias("_t")).distinct().withColumn("_t", match_key(F.col("_t")))
    days = _holding(names, told, scope, least).select(*scope, "_k", "date").distinct()
    near = latest_in_window_binned(names, days.hint("merge"), on=[*scope, "_k"], reference="_ref", date="date", before=before, after=after, keys=["_name"], tie=[])
    open_ = items.join(found.select(*scope, key).distinct(), [*scope, key], "left_anti")
    return _of_items(_named(open_, scope, key, name, reference), near, scope, key, "date")


def end_notices(items: DataFrame, news: DataFrame, *, scope: Sequence[str], key: str, name: Column, since: str, until: str, title: str, date: str, words: str = "終了") -> DataFrame:
    """(scope, key, date, title): the latest announcement from ``since`` to ``until`` (columns of the items) that quotes the item and says it ends."""
    from menuflow.functions.text import match_key, quotes

    told = news.where(F.col(title).rlike(words)).select(*scope, F.col(date).alias("date"), F.col(title).alias("title"), F.explode(F.array_distinct(quotes(F.col(title)))).alias("_q")).withColumn("_k", match_key(F.col("_q")))
    named = items.select(*scope, key, F.col(since).alias("_since"), F.col(until).alias("_until"), match_key(name).alias("_k")).where(F.col("_k") != "")
    hit = told.join(named, [*scope, "_k"]).where(F.col("date").between(F.col("_since"), F.col("_until")))
    return hit.groupBy(*scope, key).agg(F.max(F.struct("date", "title")).alias("_b")).select(*scope, key, "_b.*")


def _review_names(a: DataFrame, b: DataFrame, scope: Sequence[str], least: int) -> DataFrame:
    """(scope, _x, _y): each name ``_x`` of items once with each name ``_y`` of reviews that is equal, or the shorter of both (of at least ``least`` signs) within
    the longer. Both directions are equi-joins on first signs."""
    from menuflow.functions.text import review_key

    names = a.select(*scope, "_x").distinct().withColumn("_a", review_key(F.col("_x"))).where(F.col("_a") != "")
    told = b.select(*scope, "_y").distinct().withColumn("_b", review_key(F.col("_y"))).where(F.col("_b") != "")
    keys = names.select(*scope, F.col("_a").alias("_k"), F.col("_a").alias("_t")).distinct()
    others = told.select(*scope, F.col("_b").alias("_k"), F.col("_b").alias("_t")).distinct()
    equal = keys.select(*scope, F.col("_k").alias("_a"), F.col("_k").alias("_b")).join(others.select(*scope, F.col("_k").alias("_b")).hint("merge"), [*scope, "_b"]).select(*scope, "_a", "_b")
    inside = _holding(keys.select(*scope, "_k"), others.select(*scope, "_t"), scope, least).select(*scope, F.col("_k").alias("_a"), F.col("_t").alias("_b"))
    around = _holding(others.select(*scope, "_k"), keys.select(*scope, "_t"), scope, least).select(*scope, F.col("_t").alias("_a"), F.col("_k").alias("_b"))
    alike = equal.unionByName(inside).unionByName(around).distinct()
    return alike.join(names.hint("merge"), [*scope, "_a"]).join(told.hint("merge"), [*scope, "_b"]).select(*scope, "_x", "_y")


def review_links(items: DataFrame, reviews: DataFrame, *, scope: Sequence[str], key: str, name: Column, launch: str, review: str, review_name: Column, date: str, least: int = 6, early: int = 14) -> DataFrame:
    """(scope, key, review): reviews of an item: equal names, or the shorter (of at least ``least`` signs) within the longer; not if the item
    was launched more than ``early`` days after the review. Names meet once each, then all pairs are formed, as the result says."""
    a = items.select(*scope, key, F.col(launch).alias("_launch"), name.alias("_x"))
    b = reviews.select(*scope, review, F.col(date).alias("_date"), review_name.alias("_y"))
    late = F.datediff("_launch", "_date") > early
    told = b.join(_review_names(a, b, scope, least).hint("merge"), [*scope, "_y"])
    return a.join(told.hint("merge"), [*scope, "_x"]).where(~F.coalesce(late, F.lit(False))).select(*scope, key, review).distinct()


def review_counts(items: DataFrame, reviews: DataFrame, *, scope: Sequence[str], key: str, name: Column, launch: str, review: str, review_name: Column, date: str, least: int = 6, early: int = 14) -> DataFrame:
    """(scope, key, reviews, first, last): the number, least and greatest of each item's :func:`review_links`, without forming them.

    Reviews are counted by item name and day, the counts of a name summed up from its latest day back, and an item takes the sum at the first day that counts for it. Only items
    with several names form their pairs, since a review may link to more than one of them."""
    day = lambda c: F.unix_date(F.to_date(F.col(c)))
    # without a launch or a date nothing is too early
    a = items.select(*scope, key, F.coalesce(day(launch) - early, F.lit(-(1 << 31))).alias("_from"), name.alias("_x")).where(F.col("_x").isNotNull())
    b = reviews.select(*scope, F.col(review).alias("_review"), F.coalesce(day(date), F.lit((1 << 31) - 1)).alias("_day"), review_name.alias("_y"))
    told = b.join(_review_names(a, b, scope, least).hint("merge"), [*scope, "_y"]).groupBy(*scope, "_x", "_review").agg(F.max("_day").alias("_day"))
    days = told.groupBy(*scope, "_x", F.col("_day").alias("_from")).agg(F.count(F.lit(1)).alias("reviews"), F.min("_review").alias("first"), F.max("_review").alias("last"), F.lit(0).alias("_is"))
    named = a.groupBy(*scope, key, "_x").agg(F.min("_from").alias("_from")).withColumn("_names", F.count(F.lit(1)).over(Window.partitionBy(*scope, key)))
    single, several = named.where("_names = 1"), named.where("_names > 1")
    starts = single.select(*scope, "_x", "_from").distinct().withColumn("_is", F.lit(1))
    back = Window.partitionBy(*scope, "_x").orderBy(F.desc("_from"), "_is").rowsBetween(Window.unboundedPreceding, 0)
    line = days.unionByName(starts, allowMissingColumns=True)
    sums = line.select(*scope, "_x", "_from", "_is", *(f(c).over(back).alias(c) for f, c in ((F.sum, "reviews"), (F.min, "first"), (F.max, "last")))).where("_is = 1 and reviews > 0").drop("_is")
    counted = single.join(sums.hint("merge"), [*scope, "_x", "_from"])
    pairs = several.join(told.hint("merge"), [*scope, "_x"]).where(F.col("_day") >= F.col("_from")).select(*scope, key, "_review").distinct()
    paired = pairs.groupBy(*scope, key).agg(F.count(F.lit(1)).alias("reviews"), F.min("_review").alias("first"), F.max("_review").alias("last"))
    columns = [*scope, key, "reviews", "first", "last"]
    return counted.select(*columns).unionByName(paired.select(*columns))


def unmatched(items: DataFrame, found: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Items that still lack a launch and have no match yet: what the next run tries again."""
    return items.where("launch_date is null and not coalesce(is_regular, false)").join(found.select(*keys), [*keys], "left_anti")


def near_misses(items: DataFrame, reviews: DataFrame, linked: DataFrame, *, scope: Sequence[str], key: str, name: Column, review: str, review_name: Column, least: int = 4, limit: int = 20) -> DataFrame:
    """(scope, review, key, common): for reviews without a link, the ``limit`` pairs of a scope with the longest common beginning of at least ``least``
    signs; ties by review and key. A report: pairs meet by their first ``least`` signs."""
    from menuflow.functions.text import common_prefix, review_key

    open_ = reviews.join(linked.select(*scope, review).distinct(), [*scope, review], "left_anti").select(*scope, review, review_key(review_name).alias("_b"))
    a = items.select(*scope, key, review_key(name).alias("_a"))
    head = lambda df, c: df.where(F.length(c) >= least).withColumn("_run", F.substring(c, 1, least))
    pairs = head(open_, "_b").join(head(a, "_a"), [*scope, "_run"]).select(*scope, review, key, common_prefix(F.col("_a"), F.col("_b")).alias("common")).distinct()
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("common"), review, key)))
    return ranked.where(F.col("_r") <= limit).drop("_r")
