import datetime as dt
import random

from menuflow.operators.snapshot_diff import diff_snapshots

ROWS = "chain string, run_date date, run_seq int, page_ord int, card_ord int, product_id string, price int, status string, fields string, n int"
RUNS = "chain string, run_date date, run_seq int, ok boolean, extra string"
DAY = [dt.date(2026, 1, d) for d in range(1, 29)]


def test_changes_ties_nulls_and_clashing_columns(spark, rows):
    r = [
        ("a", DAY[0], 1, 1, 1, "X1", 100, "on", "x", 1),
        ("a", DAY[0], 1, 1, 2, "x1", 999, "on", "x", 1),  # later in the listing: doesn't count
        ("a", DAY[0], 1, 1, 3, "gone", 5, "on", "x", 1),
        ("a", DAY[0], 2, 1, 1, "never", 5, "on", "x", 1),  # run isn't ok
        ("a", DAY[2], 1, 1, 1, " ｘ１　", None, "ON ", "x", 1),
        ("a", DAY[2], 1, 1, 1, " ｘ１　", None, "ON ", "x", 1),  # copied row
        ("a", DAY[2], 1, None, None, "new", 5, None, "x", 1),
        ("a", DAY[2], 1, 1, 1, None, 5, "on", "x", 1),
        ("b", DAY[2], 1, 1, 1, "only", 5, "on", "x", 1),
        (None, DAY[2], 1, 1, 1, "x", 5, "on", "x", 1),
    ]
    runs = [("a", DAY[0], 1, True, ""), ("a", DAY[0], 2, False, ""), ("a", DAY[1], 1, None, ""), ("a", DAY[2], 1, True, ""), ("a", DAY[2], 1, True, ""), ("a", DAY[3], 1, True, ""), ("b", DAY[2], 1, True, "")]
    found = diff_snapshots(spark.createDataFrame(r, ROWS), spark.createDataFrame(runs, RUNS))
    assert rows(found) == [
        ("a", "gone", DAY[2], "removed", ""),
        ("a", "new", DAY[2], "added", ""),
        ("a", "new", DAY[3], "removed", ""),  # a snapshot without rows
        ("a", "x1", DAY[2], "changed", "price"),
        ("a", "x1", DAY[3], "removed", ""),
    ]


def test_empty(spark):
    assert diff_snapshots(spark.createDataFrame([], ROWS), spark.createDataFrame([], RUNS)).count() == 0


def test_against_brute_force(spark, rows):
    rnd = random.Random(1)
    runs = [(c, d, 1, rnd.random() < 0.8, "") for c in "ab" for d in DAY[:8]]
    data = [(c, d, 1, rnd.randint(1, 3), rnd.randint(1, 3), f"p{rnd.randint(1, 12)}", rnd.choice([None, 1, 2]), rnd.choice(["on", "off", None]), "", 0) for c in "ab" for d in DAY[:8] for _ in range(10)]
    expected = []
    for c in "ab":
        before = None
        for d in [x[1] for x in runs if x[0] == c and x[3]]:
            now = {}
            for row in sorted((x for x in data if x[:2] == (c, d)), key=lambda x: (x[3], x[4], x[6] is not None, x[6] or 0, x[7] is not None, x[7] or "")):
                now.setdefault(row[5], (row[6], row[7]))
            if before is not None:
                for k in now.keys() | before.keys():
                    if k not in before or k not in now:
                        expected.append((c, k, d, "added" if k in now else "removed", ""))
                    elif now[k] != before[k]:
                        expected.append((c, k, d, "changed", ",".join(n for n, x, y in zip(("price", "status"), now[k], before[k]) if x != y)))
            before = now
    found = diff_snapshots(spark.createDataFrame(data, ROWS), spark.createDataFrame(runs, RUNS))
    assert rows(found) == sorted(expected, key=lambda t: tuple((x is None, str(x)) for x in t))
