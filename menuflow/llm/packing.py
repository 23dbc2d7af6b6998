"""Items packed into containers of fixed capacity, by bounded-space best fit.

Every partition keeps a fixed number of open windows. An item goes into the fullest
window that still holds it; if none does, the fullest window is emitted and a new one
opened. What stays open at the end of a partition is merged: whole windows are packed
again, as items of their fill. Only an item larger than the capacity is split,
into full containers and one rest that is packed like any other item.

Plan: one shuffle by a hash of the item, sorted within the partition so a retried task packs alike; the
packing pass holds ``windows`` numbers per capacity. There are as many packing tasks as the session shuffles into. What they leave open is merged
by capacity and block of :data:`BLOCK` tasks: a merge sees at most BLOCK x windows rows, however many items or tasks there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from menuflow.session import broadcast_if_small, cut_lineage

#: Packing tasks whose open windows are merged together.
BLOCK = 256


class Windows:
    """At most ``limit`` open windows of one capacity, kept by their free space."""

    def __init__(self, capacity: int, limit: int, new_id: Iterator[int]):
        self.capacity, self.limit, self.new_id = capacity, limit, new_id
        self.free: list[tuple[int, int]] = []  # (free space, window), ascending

    def place(self, size: int) -> tuple[int, int | None]:
        """(window, emitted window or None)."""
        emitted = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            space, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                emitted = self.free.pop(0)[1]
            space, window = self.capacity, next(self.new_id)
        if space > size or size == 0:
            insort(self.free, (space - size, window))
        return window, emitted


def _ids(start: int) -> Iterator[int]:
    while True:
        yield start
        start += 1


ASSIGNED = "limit_id int, capacity bigint, item {kind}, piece int, start bigint, size bigint, window bigint"


def merge_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """(limit_id, window, container): the windows of one capacity packed again, the fullest first, each whole."""
    pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
    capacity = int(pdf["capacity"].iloc[0]) if len(pdf) else 0
    names: dict[int, int] = {}
    target = Windows(capacity, len(pdf) + 1, _ids(0))
    out = []
    for window, fill in zip(pdf["window"], pdf["fill"]):
        container = target.place(int(fill))[0]
        out.append(names.setdefault(container, int(window)))  # a container keeps the name of its first window
    return pd.DataFrame({"limit_id": pdf["limit_id"], "window": pdf["window"], "container": out})


def pack(items: DataFrame, limits: DataFrame, *, item: str = "doc_id", size: str = "tokens", windows: int = 64, partitions: int | None = None, max_limits: int = 1000) -> DataFrame:
    """(limit_id, capacity, container, item, piece, start, size): which part of which item lies in which container.

    ``limits`` has (limit_id, capacity), at most ``max_limits`` rows; more raise a ValueError, none are dropped. ``start`` is the place of the piece in the item,
    ``piece`` counts from 0. Items without a size (null, 0 or less) lie in a container with size 0. Repeated rows
    of an item count once for each different size; items with a null key are left out. No items or no
    limits give no rows.
    """
    spark = items.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = items.schema[item].dataType.simpleString()
    asked = [tuple(r) for r in limits.select(F.col("limit_id").cast("int"), F.col("capacity").cast("bigint")).where("limit_id is not null and capacity > 0").distinct().limit(max_limits + 1).collect()]
    if len(asked) > max_limits:
        raise ValueError(f"more than {max_limits} limits")
    each = F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in sorted(asked)))
    sized = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    if not asked:
        sized, each = sized.limit(0), F.array(F.struct(F.lit(0).alias("limit_id"), F.lit(1).cast("bigint").alias("capacity")))
    zero = F.lit(0).cast("bigint")
    parts = (
        sized.distinct()
        .repartition(count, F.xxhash64("item"))
        .select("item", "_size", F.inline(each))
        .select("limit_id", "capacity", "item", "_size", F.posexplode(F.sequence(zero, F.greatest(F.col("_size") - 1, zero), F.col("capacity"))).alias("piece", "start"))
        .select("limit_id", "capacity", "item", "piece", "start", F.least("capacity", F.col("_size") - F.col("start")).alias("size"))
        .sortWithinPartitions(F.xxhash64("item", "piece"), "item", "piece", "start", "size", "limit_id")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        new = _ids(TaskContext.get().partitionId() << 40)
        open_: dict[int, Windows] = {}
        for pdf in batches:
            out = []
            for limit, capacity, n in zip(pdf["limit_id"], pdf["capacity"], pdf["size"]):
                if limit not in open_:
                    open_[limit] = Windows(int(capacity), windows, new)
                out.append(next(new) if n == capacity else open_[limit].place(int(n))[0])
            yield pdf[["limit_id", "capacity", "item", "piece", "start", "size"]].assign(window=out)
        rest = [(limit, w.capacity, None, -1, w.capacity - space, 0, window) for limit, w in open_.items() for space, window in w.free]
        if rest:
            yield pd.DataFrame(rest, columns=["limit_id", "capacity", "item", "piece", "start", "size", "window"])

    # windows that are still open come as rows without an item, with their fill as start
    placed = cut_lineage(parts.mapInPandas(run, ASSIGNED.format(kind=kind)))
    left_over = placed.where("piece = -1").select("limit_id", "capacity", "window", F.col("start").alias("fill"))
    merged = left_over.groupBy("limit_id", F.floor(F.col("window") / (BLOCK << 40))).applyInPandas(merge_windows, "limit_id int, window bigint, container bigint")
    return (
        placed.where("piece >= 0")
        .join(broadcast_if_small(merged, 200_000), ["limit_id", "window"], "left")
        .select("limit_id", "capacity", F.coalesce("container", "window").alias("container"), F.col("item").alias(item), "piece", "start", "size")
    )
