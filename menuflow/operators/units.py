"""Quantities in different units brought to common ones.

A *notation* is a unit as written, after folding of widths and case. Two amounts that tell
one quantity in different notations (lines of one record and nutrient, or both in one line)
link them: scale and offset of a pair come from medians and quartiles over its links and are
propagated from the anchors (kcal, mg) through the graph of notations. Where no links reach, a nutrient itself is the common
entity: its level is the same in every notation, so medians of many lines estimate a notation's scale, again
propagated from the anchors through the graph whose nodes are notations and nutrients. An estimate is snapped to the nearest known
conversion if it is certain: if its standard error keeps every other conversion away. Only where no estimate is
certain the unit's name decides. :func:`conversions` says for each notation what decided.

Everything that is gathered is per (nutrient, notation): its size depends on how
many ways of writing a unit exist, not on the number of lines. The lines are
parsed once and written; estimates are map-side aggregated, and the small conversion
table is joined to the written lines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuflow.functions.plain import half_width
from menuflow.session import broadcast_if_small, cut_lineage

# How the nutrients are labelled (after folding).
NUTRIENTS = {
    "kcal": ("エネルギー", "エネルギー量", "熱量", "カロリー", "energy", "calories"),
    "protein_g": ("たんぱく質", "タンパク質", "蛋白質", "protein"),
    "fat_g": ("脂質", "総脂質", "fat"),
    "carbs_g": ("炭水化物", "炭水化物計", "carbohydrate"),
    "salt_g": ("食塩相当量", "食塩", "塩分", "salt"),
    "sodium": ("ナトリウム", "sodium", "na"),
    "sugar_g": ("糖質", "sugar"),
    "fiber_g": ("食物繊維", "fiber"),
}
# Known conversions of energy to kcal and of mass to mg.
KNOWN = {
    "energy": {"kcal": 1.0, "cal": 0.001, "kJ": 1 / 4.184, "MJ": 1000 / 4.184},
    "mass": {"mg": 1.0, "g": 1000.0, "kg": 1_000_000.0, "µg": 0.001},
}
# What unit a folded notation names.
NAMED = {
    "kcal": ("kcal", "キロカロリー", "kカロリー"),
    "cal": ("cal", "カロリー"),
    "kJ": ("kj", "キロジュール"),
    "MJ": ("mj", "メガジュール"),
    "mg": ("mg", "ミリグラム"),
    "g": ("g", "gram", "grams", "グラム", "gr"),
    "kg": ("kg", "キログラム"),
    "µg": ("μg", "mcg", "マイクログラム", "ug"),
}
SALT_PER_SODIUM = 2.54
#: The standard error of a median is this times the distance of the quartiles over the root of the number of values (of a normal distribution).
MEDIAN_ERROR = 1.2533 / 1.349
# Half-width katakana and squared or micro signs with their usual forms.
HALF_KANA = "ｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜｦﾝｧｨｩｪｫｬｭｮｯｰ"
FULL_KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲンァィゥェォャュョッー"
VOICED = {"ｶﾞ": "ガ", "ｷﾞ": "ギ", "ｸﾞ": "グ", "ｹﾞ": "ゲ", "ｺﾞ": "ゴ", "ｼﾞ": "ジ", "ﾀﾞ": "ダ", "ﾊﾟ": "パ"}
SQUARED = {"㌘": "グラム", "㍉": "ミリ", "㌔": "キロ", "㎎": "mg", "㎏": "kg", "㎍": "μg", "㎉": "kcal", "㎈": "cal", "µ": "μ"}


def fold(c: Column) -> Column:
    """Widths, squared signs and case folded, blanks removed."""
    for odd, usual in (VOICED | SQUARED).items():
        c = F.replace(c, F.lit(odd), F.lit(usual))
    return F.lower(F.regexp_replace(F.translate(half_width(c), HALF_KANA, FULL_KANA), r"(?U)\s+", ""))


NUMBER = r"[0-9]+(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]*\.?[0-9]+"
UNIT = "|".join(sorted((n for names in NAMED.values() for n in names), key=len, reverse=True))
#: A unit as written: letters or katakana with μ.
WORD = r"[a-zμァ-ヴー]+"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_id, nutrient, dimension, notation, value, record_id, aside): one row per line that states one amount with a unit.

    The unit is what follows the number, else the unit column, else what stands in brackets or behind a
    slash in the label. Left out: lines of an unknown nutrient, bounds (<, 未満, 以下, 以上 ...), ranges, words,
    numbers without any unit. Of two amounts in a line the first counts if the second stands in brackets
    (another energy, a portion); ``aside`` is the second, as (notation, value). Repeated rows give the row once; nulls in any column are no error.
    """
    folded = _once(lines, ["line_id", "record_id", "amount"], label=fold(F.col("nutrient_label")), text=fold(F.col("amount_text")), unit=fold(F.col("unit")))
    # what is left of the text without a label before it, remarks behind it and words that only say "about"
    main = F.regexp_replace("text", r"[(\[/*※].*$", "")
    main = F.regexp_replace(main, r"^[^0-9<>≦≧≤≥〜~]*[:=]", "")
    main = F.regexp_replace(main, r"^(?:約|およそ|推定|ほぼ|ca\.?|approx\.?)+|(?:前後|程度|くらい|ぐらい|ほど|弱|強)+$", "")
    name = F.regexp_extract("label", r"^([^(\[/:]+)", 1)
    behind = F.nullif(F.regexp_extract("label", rf"[(\[/]({WORD})[)\]]?$", 1), F.lit(""))
    second = [F.regexp_extract("text", rf"[(\[/]({NUMBER})({WORD})[)\]]?$", i) for i in (1, 2)]
    cut = _once(folded, ["line_id", "record_id", "amount"], second=second[0], aside=F.nullif(second[1], F.lit("")), name=name, main=main, silent=F.coalesce(F.col("text"), F.lit("")) == "", unit=F.nullif("unit", F.lit("")), behind=behind)
    nutrient = F.coalesce(*(F.when(F.col("name").isin(*names), F.lit(key)) for key, names in NUTRIENTS.items()))
    shape = rf"^({NUMBER})({WORD})?$"
    number = F.nullif(F.regexp_replace(F.regexp_extract("main", shape, 1), ",", ""), F.lit("")).cast("double")
    beside = F.when(~F.col("silent"), F.nullif(F.regexp_extract("main", shape, 2), F.lit("")))
    return (
        _once(cut, ["line_id", "record_id", "second", "aside"], nutrient=nutrient, notation=F.coalesce(beside, "unit", "behind"), value=F.when(F.col("silent"), F.col("amount")).otherwise(number))
        .where(F.col("line_id").isNotNull() & F.col("nutrient").isNotNull() & F.col("notation").isNotNull() & (F.col("value") >= 0))
        .groupBy("line_id", "nutrient", "notation", "value")
        .agg(F.min("record_id").alias("record_id"), F.min(F.when(F.col("aside").isNotNull(), F.struct(F.col("aside").alias("notation"), F.regexp_replace("second", ",", "").cast("double").alias("value")))).alias("aside"))
        .withColumn("dimension", F.when(F.col("nutrient") == "kcal", "energy").otherwise("mass"))
    )


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Columns that are computed once a row: a generator of one element keeps the optimizer from copying long expressions into every place that uses them."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _named() -> Column:
    return F.coalesce(*(F.when(F.col("notation").isin(*names), F.lit(key)) for key, names in NAMED.items()))


def _as_salt(parsed: DataFrame) -> DataFrame:
    """Lines of an amount above zero, sodium told as salt."""
    sodium = F.col("nutrient") == "sodium"
    return parsed.where(F.col("value") > 0).withColumns({"nutrient": F.when(sodium, "salt_g").otherwise(F.col("nutrient")), "value": F.when(sodium, F.col("value") * SALT_PER_SODIUM).otherwise(F.col("value"))})


def linked_pairs(parsed: DataFrame) -> DataFrame:
    """(dimension, a, b, n, ratio, spread, offset, error): what ``n`` amounts in notation b are to the same quantities in a, both ways round.

    A record's only amount of a nutrient in one notation meets its only ones in others, and an amount the second one of its line. ``ratio`` is the
    logarithm of the median of b / a and ``spread`` the distance of its quartiles; ``offset`` is b's median less what a's
    gives by the slope between the quartiles, as a share of b's median: 0 where both share their zero. ``error`` is the standard error of the ratio.
    """
    only = _as_salt(parsed).where(F.col("record_id").isNotNull()).groupBy("record_id", "dimension", "nutrient", "notation").agg(F.min("value").alias("value"), F.max("value").alias("_max")).where("value = _max")
    stated = only.groupBy("record_id", "dimension", "nutrient").agg(F.collect_list(F.struct("notation", "value")).alias("_s")).where(F.size("_s") > 1)
    between = stated.select("dimension", "_s", F.explode("_s").alias("a")).select("dimension", "a", F.explode("_s").alias("b"))
    sides = F.array(F.struct("notation", "value"), F.col("aside"))
    within = parsed.where((F.col("value") > 0) & (F.col("aside.value") > 0)).select("dimension", F.explode(F.array(F.struct(sides[0].alias("a"), sides[1].alias("b")), F.struct(sides[1].alias("a"), sides[0].alias("b")))).alias("_p")).select("dimension", "_p.*")
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)
    told = (
        between.unionByName(within)
        .where(F.col("a.notation") != F.col("b.notation"))
        .groupBy("dimension", F.col("a.notation").alias("a"), F.col("b.notation").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), quartiles(F.ln(F.col("b.value") / F.col("a.value"))).alias("_r"), quartiles(F.col("a.value")).alias("_a"), quartiles(F.col("b.value")).alias("_b"))
    )
    slope = F.try_divide(F.col("_b")[2] - F.col("_b")[0], F.col("_a")[2] - F.col("_a")[0])
    return told.select("dimension", "a", "b", "n", F.col("_r")[1].alias("ratio"), (F.col("_r")[2] - F.col("_r")[0]).alias("spread"), F.coalesce(1 - slope * F.col("_a")[1] / F.col("_b")[1], F.lit(0.0)).alias("offset")).withColumn("error", MEDIAN_ERROR * F.col("spread") / F.sqrt("n"))


def linked_scales(pairs: DataFrame, *, anchors: tuple[str, ...], min_links: int, near: float) -> DataFrame:
    """(dimension, notation, links, linked, linked_error): the scales that pairs give, outward from the anchors through the graph of notations.

    Pairs of fewer than ``min_links`` links, whose quartiles differ by more than the factor ``near``, or whose offset exceeds
    ``near`` - 1, are no edges. At each step a notation takes the mean over its edges to those reached, weighted by links, until none is left to reach.
    """
    edges = pairs.where((F.col("n") >= min_links) & (F.col("spread") <= F.ln(F.lit(near))) & (F.abs("offset") <= near - 1))

    def outward(pdf: pd.DataFrame) -> pd.DataFrame:
        scale, error, found = dict.fromkeys(anchors, 0.0), dict.fromkeys(anchors, 0.0), []
        while True:
            open_edges = pdf[pdf["a"].isin(list(scale)) & ~pdf["b"].isin(list(scale))]
            if open_edges.empty:
                return pd.DataFrame(found, columns=["dimension", "notation", "links", "linked", "linked_error"])
            for b, e in open_edges.groupby("b"):
                n = int(e["n"].sum())
                scale[b] = float(((e["a"].map(scale) - e["ratio"]) * e["n"]).sum() / n)
                error[b] = math.sqrt(float(((e["error"] ** 2 + e["a"].map(error) ** 2) * e["n"] ** 2).sum())) / n
                found.append((pdf["dimension"].iloc[0], b, n, scale[b], error[b]))

    return edges.groupBy("dimension").applyInPandas(outward, "dimension string, notation string, links bigint, linked double, linked_error double")


def level_scales(parsed: DataFrame, *, anchors: tuple[str, ...], least_spread: float = 0.5) -> DataFrame:
    """(dimension, notation, support, level, level_error, offset): the scales that the nutrients' common levels give.

    In logarithms the median of a nutrient's lines in a notation is the nutrient's level less the notation's scale. The scales and levels that fit
    the medians best (least squares, weighted by lines; the anchors' scale is 0) are solved for all notations that are joined with an anchor
    through nutrients and other notations, however far. ``level_error`` is the standard error, from the quartiles of the nutrient's
    best supported notation, which are taken as at least ``least_spread`` apart (few lines tell too little of it). ``offset`` is the difference of (lower quartile / median)
    from the nutrient's, near 0 where both share their zero. A row for each notation; null where no anchor is in reach.
    """
    medians = (
        _as_salt(parsed)
        .groupBy("dimension", "nutrient", "notation")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000).alias("q"))
        .select("dimension", "nutrient", "notation", "n", F.ln(F.col("q")[1]).alias("mid"), (F.ln(F.col("q")[2] / F.col("q")[0])).alias("spread"), (F.col("q")[0] / F.col("q")[1]).alias("shape"))
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["n", "notation"]).groupby("nutrient").tail(1).set_index("nutrient")
        pdf = pdf.assign(var=(MEDIAN_ERROR * pdf["nutrient"].map(best["spread"]).clip(lower=least_spread)) ** 2 / pdf["n"])
        reached = set(anchors) & set(pdf["notation"])
        while True:
            nutrients = set(pdf.loc[pdf["notation"].isin(reached), "nutrient"])
            more = set(pdf.loc[pdf["nutrient"].isin(nutrients), "notation"])
            if more == reached:
                break
            reached = more
        inside = pdf[pdf["notation"].isin(reached)]
        levels = {x: i for i, x in enumerate(sorted(inside["nutrient"].unique()))}
        free = {x: len(levels) + i for i, x in enumerate(sorted(reached - set(anchors)))}
        a = np.zeros((len(inside), len(levels) + len(free)))
        for i, (nutrient, notation) in enumerate(zip(inside["nutrient"], inside["notation"])):
            a[i, levels[nutrient]] = 1
            if notation in free:
                a[i, free[notation]] = -1
        w = np.sqrt(inside["n"].to_numpy(float))
        told = np.linalg.lstsq(a * w[:, None], inside["mid"].to_numpy(float) * w, rcond=None)[0] if len(inside) else np.empty(0)
        out = []
        for notation, e in pdf.groupby("notation"):
            n = e["n"].sum()
            mean = {x: np.average(g["shape"], weights=g["n"]) for x, g in pdf.groupby("nutrient")}
            offset = float(np.average(e["shape"] - e["nutrient"].map(mean), weights=e["n"]))
            scale = 0.0 if notation in anchors else float(told[free[notation]]) if notation in free else None
            # how well the other notations tell the levels of its nutrients
            others = inside[inside["notation"] != notation].groupby("nutrient")["var"].agg(lambda v: 1 / (1 / v).sum())
            error = math.sqrt(((e["var"] + e["nutrient"].map(others).fillna(np.inf)) * e["n"] ** 2).sum()) / n if scale is not None and notation not in anchors else 0.0
            out.append((pdf["dimension"].iloc[0], notation, int(n), scale, error, offset))
        return pd.DataFrame(out, columns=["dimension", "notation", "support", "level", "level_error", "offset"])

    return medians.groupBy("dimension").applyInPandas(solve, "dimension string, notation string, support bigint, level double, level_error double, offset double")


def conversions(parsed: DataFrame, *, anchors: tuple[str, ...] = ("kcal", "mg"), min_links: int = 5, tolerance: float = 2.0, near: float = 1.1, certain: float = 4.0) -> DataFrame:
    """(dimension, notation, support, links, estimated, error, offset, unit, factor, decided, agrees): how a notation becomes kcal or mg.

    ``decided`` says by what: ``links`` (:func:`linked_scales`; the conversion within the factor ``near``), else ``level`` (:func:`level_scales`; within the
    factor ``tolerance``), else ``name``. An estimate decides only if it is certain: if the next known conversion lies
    farther off than the nearest by more than twice ``certain`` standard errors. So how many lines it takes follows from how much they vary and how far apart the conversions lie.

    ``agrees`` is false where a known name says another unit than what decided. A notation
    with nothing has a null factor, and its lines no result. As many rows as notations.
    """
    known = [(d, u, f) for d, units in KNOWN.items() for u, f in units.items()]

    def snap(scale: Column, error: Column, within: float) -> Column:
        options = F.array(*(F.struct(F.lit(d).alias("dimension"), F.abs(scale - F.ln(F.lit(f))).alias("off"), F.lit(u).alias("unit")) for d, u, f in known))
        own = F.array_sort(F.transform(F.filter(options, lambda c: c["dimension"] == F.col("dimension")), lambda c: F.struct(c["off"].alias("off"), c["unit"].alias("unit"))))
        sure = (own[0]["off"] <= F.ln(F.lit(within))) & (own[1]["off"] - own[0]["off"] > 2 * certain * error)
        return F.when(scale.isNotNull() & sure, own[0]["unit"])

    links = linked_scales(linked_pairs(parsed), anchors=anchors, min_links=min_links, near=near)
    dimension_of, factor = F.lit(None).cast("string"), F.lit(None).cast("double")
    for d, u, f in known:
        dimension_of = F.when(F.col("_named") == u, F.lit(d)).otherwise(dimension_of)
        factor = F.when(F.col("unit") == u, F.lit(f)).otherwise(factor)
    by_links, by_level = F.col("_linked").isNotNull(), F.col("_level").isNotNull()
    return (
        level_scales(parsed, anchors=anchors)
        .join(links, ["dimension", "notation"], "left")
        .withColumns({"_linked": snap(F.col("linked"), F.col("linked_error"), near), "_level": snap(F.col("level"), F.col("level_error"), tolerance), "_named": _named()})
        .withColumn("_named", F.when(dimension_of == F.col("dimension"), F.col("_named")))
        .withColumn("unit", F.coalesce("_linked", "_level", "_named"))
        .select(
            "dimension",
            "notation",
            "support",
            F.coalesce("links", F.lit(0)).alias("links"),
            F.exp(F.when(by_links, F.col("linked")).otherwise(F.col("level"))).alias("estimated"),
            F.when(by_links, F.col("linked_error")).otherwise(F.col("level_error")).alias("error"),
            "offset",
            "unit",
            factor.alias("factor"),
            F.when(by_links, "links").when(by_level, "level").when(F.col("_named").isNotNull(), "name").alias("decided"),
            F.coalesce(F.col("_named") == F.col("unit"), F.lit(True)).alias("agrees"),
        )
    )


def common_units(lines: DataFrame, *, max_notations: int = 10_000) -> DataFrame:
    """(line_id, nutrient, amount): whole kcal, or whole milligrams, halves rounded up; sodium as salt.

    See :func:`parse_lines` for what counts as a line, :func:`conversions` for the conversion of its notation. The
    conversions are broadcast after their number is checked against ``max_notations``; beyond it they are joined by shuffle.
    """
    parsed = cut_lineage(parse_lines(lines))
    table = broadcast_if_small(conversions(parsed).where(F.col("factor").isNotNull()).select("dimension", "notation", "factor"), max_notations)
    salt = F.when(F.col("nutrient") == "sodium", F.lit(SALT_PER_SODIUM)).otherwise(F.lit(1.0))
    exact = F.round(F.col("value") * F.col("factor") * salt, 6)
    return parsed.join(table, ["dimension", "notation"]).select(
        "line_id", F.when(F.col("nutrient") == "sodium", "salt_g").otherwise(F.col("nutrient")).alias("nutrient"), F.floor(exact + 0.5).cast("bigint").alias("amount")
    )
