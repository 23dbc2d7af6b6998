import datetime as dt
import random

import pytest

from menuflow.operators.attribute_history import as_of, build_history, versions, write_store

SCHEMA = "update_id bigint, chain string, product_id string, observed_at timestamp_ntz, received_at timestamp_ntz, price int, status string, at string"
T0 = dt.datetime(2026, 1, 1)


def data(rnd, n=400):
    return [(i, rnd.choice("ab"), f"p{rnd.randint(1, 4)}", T0 + dt.timedelta(hours=rnd.randint(0, 400)), T0 + dt.timedelta(hours=rnd.randint(0, 3)), rnd.choice([None, 1, 2, 3]), rnd.choice([None, "on", "off"]), "x") for i in range(n)]


def brute(rows):
    best = {}
    for r in rows:
        k = (r[1], r[2], r[3])
        if k not in best or (r[4], r[0]) > (best[k][4], best[k][0]):
            best[k] = r
    out = []
    for key in sorted({k[:2] for k in best}):
        state, found = (None, None), []
        for (c, p, at), r in sorted((x for x in best.items() if x[0][:2] == key), key=lambda x: x[0][2]):
            new = (state[0] if r[5] is None else r[5], state[1] if r[6] is None else r[6])
            if new != state:
                found.append((at, new))
            state = new
        out += [(*key, at, found[i + 1][0] if i + 1 < len(found) else None, *v) for i, (at, v) in enumerate(found)]
    return out


@pytest.mark.parametrize("period", [3600, 86400, 10**9])
def test_versions_equal_a_fold(spark, rows, period):
    d = data(random.Random(period))
    store = build_history(spark.createDataFrame(d + d[:50], SCHEMA), period_seconds=period)
    expected = brute(d)
    assert rows(versions(store)) == sorted(expected, key=lambda t: tuple((x is None, str(x)) for x in t))
    moment = T0 + dt.timedelta(hours=200, minutes=30)
    state = sorted((c, p, a, b) for c, p, start, end, a, b in expected if start <= moment and (end is None or end > moment))
    assert rows(as_of(store, str(moment))) == sorted(state, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_odd_input(spark, rows):
    d = [
        (1, "a", None, T0, T0, 1, "on", ""),
        (2, "a", "p", None, T0, 1, "on", ""),
        (3, "a", "p", T0, None, 1, "on", ""),
        (4, "a", " Ｐ ", T0, T0, None, None, ""),  # stands as a whole: later received
        (5, "a", "p", T0 + dt.timedelta(hours=1), T0, None, " ON", ""),
        (6, None, "p", T0, T0, 7, None, ""),
    ]
    found = versions(build_history(spark.createDataFrame(d, SCHEMA)))
    assert rows(found) == [("a", "p", T0 + dt.timedelta(hours=1), None, None, "on"), (None, "p", T0, None, 7, None)]
    assert versions(build_history(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_written_store_gives_the_same_versions(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data(random.Random(5), 200), SCHEMA).withColumns({"_period": F.lit(1), "_key": F.lit("x")})
    store = build_history(df, period_seconds=86400)
    assert rows(versions(write_store(store, str(tmp_path / "store")))) == rows(versions(store))
