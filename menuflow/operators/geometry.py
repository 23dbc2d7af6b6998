"""Tables rebuilt from the geometry of a page: clusters of positions, columns, bands, nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(points: DataFrame, *, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """(keys, cluster, low, high, centre, n): neighbours at most ``tolerance`` apart form one cluster, counted from 0 by position. Null values are left out.

    Points are first summed up in bins as wide as ``tolerance``, in the map tasks: points of one bin belong together, and points with an empty bin between them
    don't. Only the bins of a key are sorted, not its points.
    """
    bins = points.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(F.col(value) / tolerance).alias("_bin")).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    marked = bins.withColumn("_new", F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > tolerance, F.lit(False)).cast("int"))
    numbered = marked.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by = numbered.groupBy(*keys, F.col("cluster").cast("int").alias("cluster")).agg(F.min("_lo").alias("low"), F.max("_hi").alias("high"), F.sum("_sum").alias("_sum"), F.sum("_n").alias("n"))
    return by.select(*keys, "cluster", "low", "high", (F.col("_sum") / F.col("n")).alias("centre"), "n")


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of the band [edge i, edge i+1) that holds ``value``; null outside. One expression instead of a range join."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        out = F.when((value >= lo) & (value < hi), F.lit(i)).otherwise(out)
    return out


def assign_bands(points: DataFrame, bands: DataFrame, *, keys: Sequence[str], value: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the band of their keys that holds ``value`` (low <= value < high), as an equi-join on bins of ``width``."""
    cut = bands.select(*keys, low, high, "band", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))).alias("_bin"))
    return points.withColumn("_bin", F.floor(F.col(value) / width)).join(cut, [*keys, "_bin"]).where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")


def nearest(points: DataFrame, targets: DataFrame, *, keys: Sequence[str], point: str, value: str, target: str, at: str, most: float) -> DataFrame:
    """(keys, point, target, distance): the target of the same keys nearest to each point, at most ``most`` away; ties by target.

    In bins as wide as ``most``, points stand in a row with the distinct positions of the targets of their own and both neighbouring bins: the nearest is the last position
    before a point or the first one after it. Two sorts of a bin, no pairs of points and targets, however many of them are near each other.
    """
    bin_of = lambda c: F.floor(c / most)
    for c in keys:
        points, targets = (df.where(F.col(c).isNotNull()) for df in (points, targets))
    spots = targets.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_at")).agg(F.min(target).alias("_t"))
    beside = F.explode(F.array(*(F.try_add(bin_of(F.col("_at")), F.lit(i)) for i in (-1, 0, 1))))
    spots = spots.select(*keys, beside.alias("_bin"), F.col("_at").alias("_o"), F.struct("_at", "_t").alias("_s"), F.lit(0).alias("_is"))
    told = points.select(*keys, bin_of(F.col(value)).alias("_bin"), F.col(value).alias("_o"), F.col(value).alias("_v"), F.col(point).alias("_p"), F.lit(1).alias("_is"))
    line = told.unionByName(spots, allowMissingColumns=True)
    # a target at the point's own position comes before it in both directions
    before, after = (F.last("_s", ignorenulls=True).over(Window.partitionBy(*keys, "_bin").orderBy(o, "_is").rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("_o"), F.desc("_o")))
    near = line.withColumns({"_l": before, "_r": after}).where("_is = 1").select(*keys, "_p", "_v", F.explode(F.array("_l", "_r")).alias("_s"))
    hit = near.select(*keys, "_p", F.abs(F.col("_v") - F.col("_s._at")).alias("_d"), F.col("_s._t").alias("_t")).where(F.col("_d") <= most)
    best = hit.groupBy(*keys, "_p").agg(F.min(F.struct("_d", F.col("_t").isNull().alias("_n"), "_t")).alias("_b"))
    return best.select(*keys, F.col("_p").alias(point), F.col("_b._t").alias(target), F.col("_b._d").alias("distance"))


def mark_matrix(marks: DataFrame, columns: DataFrame, *, row: Sequence[str], x: str, names: Sequence[str], most: float = 9.0) -> DataFrame:
    """(row, one column per name): the mark of each row nearest to each named column's position, null where none lies within ``most``."""
    ids = marks.withColumn("_id", F.xxhash64(*row, x, "mark"))
    near = nearest(ids.withColumn("_k", F.lit(0)), columns.withColumn("_k", F.lit(0)), keys=["_k"], point="_id", value=x, target="name", at="x", most=most)
    return ids.join(near.select("_id", "name"), "_id").groupBy(*row).pivot("name", list(names)).agg(F.first("mark"))


def scaled(points: DataFrame, pages: DataFrame, *, page: Sequence[str], columns: Sequence[str], height: str, standard: float) -> DataFrame:
    """Points with their positions as on a page of the ``standard`` height, so that distances and edges hold for pages of any size. Points of pages
    without a height are left out."""
    known = pages.where(F.col(height) > 0).select(*page, (F.lit(float(standard)) / F.col(height)).alias("_f"))
    told = points.join(known, [*page])
    return told.select(*(c for c in points.columns if c not in columns), *((F.col(c) * F.col("_f")).alias(c) for c in columns))


def unglued(marks: DataFrame, *, mark: str, x: str, width: float) -> DataFrame:
    """One row for each sign of marks that stand in one piece, each ``width`` to the right of the one before it; blanks aren't marks."""
    keep = [c for c in marks.columns if c not in (mark, x)]
    signs = marks.select(*keep, F.col(x).alias("_x"), F.posexplode(F.split(mark, "")).alias("_i", mark)).where(F.trim(mark) != "")
    return signs.select(*keep, mark, (F.col("_x") + F.col("_i") * F.lit(float(width))).alias(x))


def band_names(glyphs: DataFrame, bands: DataFrame, *, keys: Sequence[str], y: str, x: str, text: str, low: str, high: str, width: float) -> DataFrame:
    """(keys, band, name, lines): the texts within each band of rule lines, joined from top (greatest y) to bottom and left to right: a name cell that spans several rows. A cell
    holds few texts, so no group grows with the data."""
    inside = assign_bands(glyphs, bands, keys=keys, value=y, low=low, high=high, width=width)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(y)).alias("y"), F.col(x).alias("x"), F.col(text).alias("t"))))
    by = inside.groupBy(*keys, "band").agg(ordered.alias("_g"), F.count_distinct(y).alias("lines"))
    return by.select(*keys, "band", F.array_join(F.transform("_g", lambda g: g["t"]), "").alias("name"), "lines")


def header_problems(headers: DataFrame, *, keys: Sequence[str], page: str, column: str, text: str) -> DataFrame:
    """(keys, page, column, text, usual): headers that differ from what most pages say of the column (ties: the smallest text); pages are expected to agree."""
    votes = headers.groupBy(*keys, column, text).agg(F.count(F.lit(1)).alias("_n"))
    usual = votes.groupBy(*keys, column).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(text).alias("t"))).alias("_u")).select(*keys, column, F.col("_u.t").alias("usual"))
    return headers.join(usual, [*keys, column]).where(~F.col(text).eqNullSafe(F.col("usual"))).select(*keys, page, column, text, "usual")


def legend_lines(lines: DataFrame, *, keys: Sequence[str], y: str, text: str, start: str, gap: float) -> DataFrame:
    """(keys, y, text): the lines that begin as ``start`` (a pattern) with the continuation lines right below them, each at most ``gap`` lower, up to the next such line."""
    w = Window.partitionBy(*keys).orderBy(F.desc(y))
    marked = lines.withColumns({"_s": F.col(text).rlike(start), "_gap": F.lag(y).over(w) - F.col(y)})
    # a line far below the one before it begins a block of its own
    block = marked.withColumn("_b", F.sum((F.col("_s") | F.coalesce(F.col("_gap") > gap, F.lit(True))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = block.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list(F.struct((-F.col(y)).alias("o"), F.col(text).alias("t")))).alias("_l"), F.max(y).alias(y), F.max("_s").alias("_is"))
    return joined.where("_is").select(*keys, y, F.array_join(F.transform("_l", lambda g: g["t"]), "").alias(text))
