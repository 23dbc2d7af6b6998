import datetime as dt
import json

import pytest

from menuflow.operators.shred import _read_deep, product_children, shred, shred_text

SCHEMA = "record_id bigint, fetched_at timestamp_ntz, body string, node string"
T0 = dt.datetime(2026, 1, 1)
BODY = {
    "product": {
        "nutrition_variants": [{"label": "S", "nutrition": {"kcal": 1, "other": {"Na": "1mg", "K": None}}, "sizes": [{"label": "m"}, None, {"label": None}]}, None, {"label": None, "nutrition": None}],
        "allergens": json.dumps({"contains": ["a", None, "b"], "partial": {"name": "c", "mark": "△"}}),
        "price_history": {"date": "2026-01-01", "price": 1},
    }
}


def test_children_of_every_shape(spark, rows):
    d = [
        (1, T0, json.dumps(BODY), "x"),
        (1, T0 - dt.timedelta(days=1), json.dumps({"price_history": [{"date": "old"}]}), "x"),
        (2, T0, "{broken", "x"),
        (3, T0, None, "x"),
        (4, T0, "", "x"),
        (5, T0, json.dumps({"price_history": [{"date": "d0"}, None, {"price": 3}], "allergens": {"contains": "lone"}, "nutrition_variants": {"label": 5}}), "x"),
        (5, T0, json.dumps({"price_history": [{"date": "d0"}, None, {"price": 3}], "allergens": {"contains": "lone"}, "nutrition_variants": {"label": 5}}), "x"),
        (6, T0, "[1, 2]", "x"),
        (None, T0, "{}", "x"),
    ]
    found = product_children(spark.createDataFrame(d, SCHEMA)).select("record_id", "child", "pos", "name")
    assert rows(found) == sorted(
        [
            (1, "contains", 0, "a"), (1, "contains", 2, "b"), (1, "partial", 0, "c"), (1, "price", 0, "2026-01-01"), (1, "variant", 0, "S"), (1, "variant", 2, ""),
            (1, "variant_other", 0, "K"), (1, "variant_other", 0, "Na"), (1, "variant_size", 0, "m"), (1, "variant_size", 0, ""),
            (5, "contains", 0, "lone"), (5, "price", 0, "d0"), (5, "price", 2, ""), (5, "variant", 0, "5"),
        ],
        key=lambda t: tuple(str(x) for x in t),
    )
    assert product_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bodies_of_any_depth_are_read(spark, rows):
    deep = '{"price_history": [{"date": "d"}], "x": ' + "[" * 200_000 + "]" * 200_000 + "}"
    df = spark.createDataFrame([(1, T0, deep, "x"), (2, T0, deep[:-1], "x")], SCHEMA)
    assert rows(product_children(df).select("record_id", "child", "pos", "name")) == [(1, "price", 0, "d")]
    for text in ('{"a": [1, -2.5e3, true, null, "x\\u00e9", {}], "b": {"c": []}}', "[]", " [ 1 , 2 ] ", "{}", "3", '"s"'):
        assert _read_deep(text) == json.loads(text)
    for text in ("", "[1,]", '{"a"}', '{"a": 1,}', "[1 2]", "[", '{"a": [}', "[1] 2", "nul", "]"):
        with pytest.raises(ValueError):
            _read_deep(text)


def test_nodes_keep_the_tree(spark):
    nodes = {n[0]: n for n in shred_text('{"a": [{"b": 1}, [2]], "c": "x"}')}
    assert nodes[0][6] == "object" and nodes[1][4] == "a"
    for n in nodes.values():
        assert n[1] is None or nodes[n[1]][8] == n[9]
    assert [(n[8], n[7]) for n in nodes.values() if n[7]] == [("$.a[].b", "1"), ("$.a[][]", "2"), ("$.c", "x")]
    deep = "[" * 5000 + "]" * 5000
    assert len(shred_text(deep)) == 5000
    wide = json.dumps({"price_history": [{"date": str(i)} for i in range(30_000)]})
    df = spark.createDataFrame([(1, T0, wide, "")], SCHEMA)
    assert shred(df, batch=1000).count() == 60_002
    assert product_children(df).count() == 30_000
