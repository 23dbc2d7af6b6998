import datetime as dt
import random

from menuflow.operators.lifecycle import changes, episodes, holds, ratio_guard, run_streaks, state, streaks
from menuflow.streaming.lifecycle import fold, track
from pyspark.sql import functions as F

DAYS = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(12)]


def matrix(seed, keys=60):
    rnd = random.Random(seed)
    ok = {d: rnd.random() < 0.75 for d in DAYS}
    return ok, {f"k{i}": [rnd.random() < 0.5 for _ in DAYS] for i in range(keys)}


def test_state_equals_the_fold_of_the_rules(spark):
    ok, seen = matrix(3)
    runs = spark.createDataFrame([("c", d, ok[d]) for d in DAYS], "chain string, run_date date, ok boolean")
    sightings = spark.createDataFrame([("c", k, d, "x") for k, row in seen.items() for d, s in zip(DAYS, row) if s], "chain string, product_id string, run_date date, status string")
    found = {r["product_id"]: r for r in state(episodes(sightings.union(sightings), runs)).collect()}
    for k, row in seen.items():
        s, relaunches, ended = None, 0, None
        for d, hit in zip(DAYS, row):
            s, events = fold(s, d, hit, ok[d], None)
            relaunches += "relaunched" in events
            ended = d if "ended" in events else None if "relaunched" in events else ended
        if s is None:
            assert k not in found
            continue
        assert (found[k]["status"], found[k]["missed"], found[k]["relaunches"], found[k]["ended"]) == (s[0], s[1], relaunches, ended), k


def test_stream_equals_the_fold(spark, tmp_path):
    ok, seen = matrix(5, keys=8)
    rows = [("c", k, d, s, ok[d], None) for k, row in seen.items() for d, s in zip(DAYS, row)]
    schema = "chain string, product_id string, run_date date, seen boolean, ok boolean, price int"
    for i in range(3):  # three batches, the last day of each again in the next one
        part = [r for r in rows if i * 4 - 1 <= DAYS.index(r[2]) < (i + 1) * 4]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = track(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    expected = []
    for k, row in seen.items():
        s = None
        for d, hit in zip(DAYS, row):
            s, events = fold(s, d, hit, ok[d], None)
            expected += [(k, d, e) for e in events]
    assert sorted(tuple(r) for r in spark.sql("select product_id, run_date, event from tracked").collect()) == sorted(expected)


def test_fixture_scenarios():
    def run(text, price=None):
        s, log = None, []
        for d, c in zip(DAYS, text):
            s, e = fold(s, d, c == "S", c != "x", None)
            log += e
        return s, log

    assert run("S.")[0][:2] == ("on_sale", 1)
    assert run("S..")[0][:2] == ("ended", 2)
    assert run("Sxx")[0][:2] == ("on_sale", 0)
    assert run("S.S.")[0][:2] == ("on_sale", 1)
    assert run("S..S")[1] == ["created", "ended", "relaunched"]
    s = ("on_sale", 0, DAYS[0], 100)
    assert fold(s, DAYS[0], False, True, None) == (s, [])  # same day again


def test_changes_streaks_holds_and_guards(spark, rows):
    d = spark.createDataFrame([("a", 1, 100), ("a", 2, 100), ("a", 3, None), ("a", 4, 120)], "k string, t int, v int")
    assert rows(changes(d, keys=["k"], at="t", value="v")) == [("a", 1, None, 100), ("a", 4, 100, 120)]
    s = spark.createDataFrame([("a", DAYS[i], i in (0, 1, 3)) for i in range(5)] * 2, "k string, d date, bad boolean")
    assert rows(streaks(s, keys=["k"], date="d", bad="bad")) == [("a", DAYS[0], DAYS[1], 2), ("a", DAYS[3], DAYS[3], 1)]
    r = spark.createDataFrame([("a", i, i in (1, 2, 3, 5)) for i in range(6)], "k string, n int, bad boolean")
    assert rows(run_streaks(r, keys=["k"], order=["n"], bad=F.col("bad"))) == [("a", 2, 4, 3)]
    h = spark.createDataFrame([("a", DAYS[i], 50, u) for i, u in enumerate([50, 40, 0, 40, 40, 40])], "k string, d date, n int, u int")
    assert [(x["held"], x["hold_days"], x["escalated"]) for x in holds(h, keys=["k"], date="d", total="n", unknown="u").orderBy("d").collect()] == [
        (False, 0, False), (True, 1, False), (False, 0, False), (True, 1, False), (True, 2, False), (True, 3, True),
    ]
    g = spark.createDataFrame([("a", DAYS[i], n) for i, n in enumerate([10, 5, 2])], "k string, d date, n int")
    assert [x["ok"] for x in ratio_guard(g, keys=["k"], date="d", n="n").orderBy("d").collect()] == [True, True, False]


def test_changes_by_period_equal_changes(spark, rows):
    import random

    from pyspark.sql import functions as F

    from menuflow.operators import lifecycle

    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), n, rnd.choice([None, 1, 2, 3])) for n in range(300)]
    df = spark.createDataFrame(data, "k string, at int, v int")
    whole = rows(lifecycle.changes(df, keys=["k"], at="at", value="v"))
    for width in (1, 10, 1000):
        assert rows(lifecycle.changes(df, keys=["k"], at="at", value="v", period=F.floor(F.col("at") / width))) == whole
