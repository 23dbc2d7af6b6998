"""One surviving record per duplicate group, field bundles chosen whole by branch and bound.

Fields that depend on each other form a *bundle* and survive together, from one record. Each
bundle ranks its usable candidates. The search takes one candidate per bundle: it fills as many bundles as
it can, then maximises the summed worth, then the ranks in the order of the bundles, and
never breaks a functional dependency between chosen fields. It goes bundle by bundle, best candidates
first, and cuts a branch when even the best of the open bundles can't beat what is found.

Pruning before the search: of candidates of one bundle that agree in every field named in a
dependency only the best can survive. A grouped maximum - reduced in the map tasks - leaves one row per
(group, bundle, agreeing values), so a bundle outside all dependencies sends one row per group into the
search, however large the group is: a group of a third of all rows costs what any other costs. Where two bundles depend on
each other only, the bound is exact before the search (:func:`prune_pair`): for each left value the best right one that may stand beside it is found by
joins and grouped maxima, and all candidates but those of the best pair and the best of each bundle are cut. So the search of
such a group has at most four candidates too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuflow.session import cut_lineage

LOWEST = -(2**62)


@dataclass(frozen=True)
class Bundle:
    """``usable``: can a record give this bundle. ``rank``: whole numbers, greater is better, null lowest; then the
    smaller key. ``fields``: the columns that survive together. ``weight``: what one point of the first rank is worth."""

    name: str
    usable: Column
    rank: Sequence[Column]
    fields: Sequence[str] = ()
    weight: int = 0


@dataclass(frozen=True)
class Dependency:
    """The (bundle, field) ``left`` decides the (bundle, field) ``right``: a chosen right value has to stand beside the chosen
    left value in some record of the group, if any record has that left value and a right one."""

    left: tuple[str, str]
    right: tuple[str, str]


def candidates(records: DataFrame, members: DataFrame, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), *, group: str = "group_id", key: str = "record_id") -> DataFrame:
    """(group, bundle, rank, key, agree): per group the candidates that can still survive, and, with an empty bundle, the
    pairs of values that occur together for each dependency.

    Members without a record don't count, repeated member rows count once; a record may be in several groups.
    """
    named = [f for d in dependencies for f in (d.left, d.right)]
    options = [
        F.struct(
            F.lit(b.name).alias("bundle"),
            F.coalesce(b.usable, F.lit(False)).alias("usable"),
            F.array(*(F.coalesce(c.cast("bigint"), F.lit(LOWEST)) for c in b.rank), -F.col(key).cast("bigint")).alias("rank"),
            F.col(key).cast("bigint").alias("key"),
            F.array(*(F.col(f).cast("string") for f in b.fields if (b.name, f) in named)).cast("array<string>").alias("agree"),
        )
        for b in bundles
    ]
    options += [
        F.struct(
            F.lit("").alias("bundle"),
            (F.col(d.left[1]).isNotNull() & F.col(d.right[1]).isNotNull()).alias("usable"),
            F.array(F.lit(i).cast("bigint")).alias("rank"),
            F.lit(0).cast("bigint").alias("key"),
            F.array(F.col(d.left[1]).cast("string"), F.col(d.right[1]).cast("string")).alias("agree"),
        )
        for i, d in enumerate(dependencies)
    ]
    slim = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.filter(F.array(*options), lambda o: o["usable"]).alias("_options"))
    pairs = members.select(F.col(group), F.col(key).alias("_key")).where(F.col(group).isNotNull()).distinct()
    return (
        pairs.join(slim, "_key")
        .select(group, F.inline("_options"))
        .groupBy(group, "bundle", "agree", F.when(F.col("bundle") == "", F.col("rank")).alias("_dep"))
        .agg(F.max(F.struct("rank", "key")).alias("_b"))
        .select(group, "bundle", "_b.rank", "_b.key", "agree")
    )


def prune_pair(kept: DataFrame, left: Bundle, right: Bundle, number: int, *, left_first: bool, group: str = "group_id") -> DataFrame:
    """The candidates without those of ``left`` and ``right`` that can't survive under dependency ``number``, the only one that either of them is in.

    With the candidates of the best allowed pair, and of the best of each bundle alone, every best choice is still there; of the pairs of values, those that
    decide between them. Nothing is gathered per group.
    """
    agree = F.col("agree")
    of = lambda name, value: kept.where(F.col("bundle") == name).select(group, agree[0].alias(value), "rank", "key")
    a, b = of(left.name, "x"), of(right.name, "y")
    pairs = kept.where((F.col("bundle") == "") & (F.col("rank")[0] == number)).select(group, agree[0].alias("x"), agree[1].alias("y"))
    best = F.max(F.struct("rank", "key", "y"))
    allowed = pairs.join(b.where("y is not null"), [group, "y"]).groupBy(group, "x").agg(best.alias("_beside"))
    told = pairs.groupBy(group, "x").agg(F.max("y").alias("_told"))
    alone = b.groupBy(group).agg(best.alias("_any"), F.max(F.when(F.col("y").isNull(), F.struct("rank", "key", "y"))).alias("_free"))
    met = a.join(told, [group, "x"], "left").join(allowed, [group, "x"], "left").join(alone, group, "left")
    beside = F.when(F.col("_told").isNull(), F.col("_any")).otherwise(F.array_max(F.filter(F.array("_beside", "_free"), lambda r: r.isNotNull())))
    met = met.withColumn("_r", beside)
    worth = lambda w, rank: w * F.greatest(F.lit(0).cast("bigint"), rank[0])
    lowest = F.array(F.lit(LOWEST - 1))
    ranks = [F.col("rank"), F.coalesce(F.col("_r")["rank"], lowest)]
    value = F.struct(
        F.col("_r").isNotNull().alias("filled"),
        (worth(left.weight, F.col("rank")) + F.coalesce(worth(right.weight, F.col("_r")["rank"]), F.lit(0))).alias("worth"),
        *(r.alias(f"rank{i}") for i, r in enumerate(ranks if left_first else ranks[::-1])),
        F.struct("rank", "key", "x").alias("a"),
        F.col("_r").alias("b"),
        F.col("_told").alias("told"),
    )
    chosen = met.groupBy(group).agg(F.max(value).alias("_p"), F.max(F.struct(F.struct("rank", "key", "x").alias("a"), F.col("_told").alias("told"))).alias("_a"))

    def row(bundle: str, c: Column, value: str) -> Column:
        return F.struct(F.lit(bundle).alias("bundle"), c["rank"].alias("rank"), c["key"].alias("key"), F.array(c[value]).alias("agree"))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.lit("").alias("bundle"), F.array(F.lit(number).cast("bigint")).alias("rank"), F.lit(0).cast("bigint").alias("key"), F.array(x, y).alias("agree"))

    p, alone_a = F.col("_p"), F.col("_a")
    beside_told = p["told"].isNotNull() & p["b"]["y"].isNotNull()
    rows = F.array(
        row(left.name, p["a"], "x"),
        row(left.name, alone_a["a"], "x"),
        F.when(p["b"].isNotNull(), row(right.name, p["b"], "y")),
        F.when(p["told"].isNotNull(), pair(p["a"]["x"], p["told"])),
        F.when(beside_told, pair(p["a"]["x"], p["b"]["y"])),
        F.when(alone_a["told"].isNotNull(), pair(alone_a["a"]["x"], alone_a["told"])),
    )
    of_left = chosen.select(group, F.inline(F.array_distinct(F.filter(rows, lambda r: r.isNotNull()))))
    of_right = alone.select(group, row(right.name, F.col("_any"), "y").alias("_row")).select(group, "_row.*")
    others = kept.where(~F.col("bundle").isin(left.name, right.name) & ~((F.col("bundle") == "") & (F.col("rank")[0] == number)))
    return others.unionByName(of_left).unionByName(of_right).distinct()


def search(found: Sequence[tuple[str, list[int], int, list[str]]], bundles: Sequence[tuple[str, int, Sequence[str]]], dependencies: Sequence[Dependency] = ()) -> dict[str, int]:
    """Branch and bound over one group's candidates (bundle, rank, key, agreeing values): the chosen key of each filled bundle.

    ``bundles`` are (name, weight, fields named in dependencies). A bundle without a fitting candidate stays empty.
    """
    by: dict[str, list] = defaultdict(list)
    beside: list[dict[str, set]] = [defaultdict(set) for _ in dependencies]
    for name, rank, key, agree in found:
        if name:
            by[name].append((list(rank), key, list(agree)))
        else:
            beside[rank[0]][agree[0]].add(agree[1])
    for options in by.values():
        options.sort(key=lambda o: o[0], reverse=True)
    order = [b for b in bundles if by[b[0]]]
    # what the bundles from i on can add at most
    most = [(0, 0)]
    for name, weight, _ in reversed(order):
        most.append((most[-1][0] + 1, most[-1][1] + max(0, weight * max(0, by[name][0][0][0]))))
    most.reverse()
    best: tuple | None = None
    chosen: dict[str, int] = {}

    def fits(told: dict) -> bool:
        for i, d in enumerate(dependencies):
            left, right = told.get(d.left), told.get(d.right)
            if left is not None and right is not None and beside[i].get(left) and right not in beside[i][left]:
                return False
        return True

    # an explicit stack: (bundle, filled, worth, ranks, picks, told)
    stack: list[tuple] = [(0, 0, 0, (), {}, {})]
    while stack:
        i, filled, worth, ranks, picks, told = stack.pop()
        if best is not None and (filled + most[i][0], worth + most[i][1]) < best[:2]:
            continue
        if i == len(order):
            if best is None or (filled, worth, ranks) > best:
                best, chosen = (filled, worth, ranks), picks
            continue
        name, weight, fields = order[i]
        branches = [(i + 1, filled, worth, (*ranks, (LOWEST - 1,)), picks, told)] if dependencies else []
        for rank, key, agree in reversed(by[name]):
            new = told | {(name, f): v for f, v in zip(fields, agree) if v is not None}
            if fits(new):
                branches.append((i + 1, filled + 1, worth + weight * max(0, rank[0]), (*ranks, tuple(rank)), {**picks, name: key}, new))
        stack += branches  # the best candidate is looked at first
    return chosen


def choose_bundles(records: DataFrame, members: DataFrame, bundles: Sequence[Bundle], dependencies: Sequence[Dependency] = (), *, group: str = "group_id", key: str = "record_id") -> DataFrame:
    """(group, bundle, key): which record each surviving bundle of a group comes from; no row where none is usable.

    Nulls in a rank are lowest; ties go to the smaller key. Groups without a record, and empty tables, give no rows.
    The search of a group is one row of its remaining candidates: one of a bundle outside dependencies, two of one in a single dependency
    with another that is in no other; bundles in several dependencies bring as many as they have different values there.
    """
    named = [f for d in dependencies for f in (d.left, d.right)]
    plan = [(b.name, b.weight, [f for f in b.fields if (b.name, f) in named]) for b in bundles]
    kept = candidates(records, members, bundles, dependencies, group=group, key=key)
    by_name = {b.name: (i, b) for i, b in enumerate(bundles)}
    uses = [side for d in dependencies for side in (d.left[0], d.right[0])]
    for i, d in enumerate(dependencies):
        (at, a), (bt, b) = by_name[d.left[0]], by_name[d.right[0]]
        if uses.count(a.name) == uses.count(b.name) == 1 and min(a.weight, b.weight) >= 0:
            kept = prune_pair(cut_lineage(kept), a, b, i, left_first=at < bt, group=group)
    rows = kept.groupBy(group).agg(F.collect_list(F.struct("bundle", "rank", "key", "agree")).alias("c"))
    kind = members.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, c in zip(pdf["g"], pdf["c"]):
                found = [(x["bundle"], x["rank"], x["key"], x["agree"]) for x in c]
                out += [(g, name, k) for name, k in search(found, plan, dependencies).items()]
            yield pd.DataFrame(out, columns=["g", "bundle", "k"])

    chosen = rows.select(F.col(group).alias("g"), "c").mapInPandas(run, f"g {kind}, bundle string, k bigint")
    return chosen.select(F.col("g").alias(group), "bundle", F.col("k").alias(key))


def day(c: Column, years: tuple[int, int] = (2015, 2026)) -> Column:
    """The day that a text states, year first, in digits (of any width) with -, /, . or 年月日 or nothing between; null if it isn't a real day of these years."""
    from menuflow.functions.plain import half_width

    plain = F.regexp_replace(half_width(c), r"\s+", "")
    parts = F.regexp_extract_all(F.regexp_replace(plain, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "$1-$2-$3"), F.lit(r"^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?(?:T.*)?$"), F.lit(0))
    text = F.regexp_replace(F.get(parts, F.lit(0)), r"日?(?:T.*)?$", "")
    at = F.split(text, r"[-/.年月]")
    whole = F.concat_ws("-", F.get(at, F.lit(0)), F.lpad(F.get(at, F.lit(1)), 2, "0"), F.lpad(F.get(at, F.lit(2)), 2, "0")).try_cast("date")
    return F.when(F.year(whole).between(*years), whole)


def product_bundles(records: DataFrame, trust: DataFrame) -> tuple[DataFrame, list[Bundle]]:
    """Products with their source's trust and path of address, and the bundles of the surviving fields.

    Usable and preferred: first_seen_at from 2015 on and not after the own last_seen_at, the earliest; launch_date a real day
    and official_url an address with a path, by trust, then latest last_seen_at; price_history by good entries (date told, price
    above 0), then likewise.
    """
    known = records.join(trust.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("trust").alias("_trust")), "source", "left")
    seen = F.unix_date("last_seen_at")
    by_trust = [F.col("_trust"), seen]
    first = F.col("first_seen_at")
    good = F.size(F.filter(F.coalesce("price_history", F.array().cast(records.schema["price_history"].dataType)), lambda e: e["date"].isNotNull() & (F.trim(e["date"]) != "") & (e["price"] > 0)))
    sound = (F.year(first) >= 2015) & (F.col("last_seen_at").isNull() | (F.to_date(first) <= F.col("last_seen_at")))
    return known, [
        Bundle("first_seen_at", sound, [-F.unix_micros(first.cast("timestamp"))], ("first_seen_at",)),
        Bundle("launch_date", day(F.col("launch_date")).isNotNull(), by_trust, ("launch_date", "launch_date_source"), weight=1),
        Bundle("official_url", F.trim("official_url").rlike(r"^(?i)https?://[^/?#\s]+/[^?#\s]*[^/?#\s]"), by_trust, ("official_url", "product_id"), weight=1),
        Bundle("price_history", good > 0, [good, *by_trust], ("price_history", "price"), weight=1),
    ]
