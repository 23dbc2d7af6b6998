"""The lifecycle as a stream: keyed state, one observation per item and day, absences only on complete days.

The batch form (:mod:`menuflow.operators.lifecycle`) needs all sightings; this one folds the days as
they come. A run sends, for every item it lists, a row with ``seen`` true, and, when it is
closed as complete, a row with ``seen`` false for every known item it lacks. Rows of one key
are folded in the order of their days within a batch; a day that isn't after the last one folded is
ignored (same-day repetition, late rows), so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "chain string, product_id string, run_date date, event string, status string, missed int, price int"
STATE = "status string, missed int, last_day date, price int"


def fold(state: tuple | None, day: object, seen: bool, ok: bool, price: int | None, patience: int = 2) -> tuple[tuple | None, list[str]]:
    """One step: (status, missed, last day, price) and an observation give the next state and what happened."""
    if state is None:
        return (("on_sale", 0, day, price), ["created"]) if seen else (None, [])
    status, missed, last, known = state
    if last is not None and day <= last:
        return state, []
    events = []
    if seen:
        if status == "ended":
            events.append("relaunched")
        if price is not None and known is not None and price != known:
            events.append("price_changed")
        return ("on_sale", 0, day, known if price is None else price), events
    if status == "on_sale" and ok:
        missed += 1
        if missed >= patience:
            status = "ended"
            events.append("ended")
    return (status, missed, day, known), events


def track(observations: DataFrame, patience: int = 2) -> DataFrame:
    """Events of a stream of (chain, product_id, run_date, seen, ok, price): created, price_changed, ended, relaunched."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["run_date", "seen"], ascending=[True, False])
        for day, seen, ok, price in zip(rows["run_date"], rows["seen"], rows["ok"], rows["price"]):
            state, events = fold(state, day, bool(seen), bool(ok), None if pd.isna(price) else int(price), patience)
            out += [(*key, day, e, state[0], state[1], state[3]) for e in events]
        if state is not None:
            held.update(state)
        yield pd.DataFrame(out, columns=["chain", "product_id", "run_date", "event", "status", "missed", "price"])

    keyed = observations.where("product_id is not null and run_date is not null").groupBy("chain", "product_id")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, *, at: str = "ts", late: str = "1 hour", window: str = "6 hours", by: str = "event_type") -> DataFrame:
    """Counts per window and ``by``; rows later than the watermark are dropped. Timestamps without zone are taken as UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"))
