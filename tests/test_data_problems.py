"""Problems 3 and 6 over the small test tables against a plain, single-process computation."""

import json
import os
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import pytest

from menuflow.plans import data_problems

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def read(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pylist()


def listed(x):
    return x if isinstance(x, list) else [] if x is None else [x]


def text(x):
    return "" if x is None else x if isinstance(x, str) else json.dumps(x)


def test_children(spark):
    latest = {}
    for r in read("raw_records"):
        new = (r["fetched_at"], r["body"] or "")
        latest[r["record_id"]] = max(latest.get(r["record_id"], new), new)
    expected = set()
    for rid, (_, body) in latest.items():
        try:
            j = json.loads(body)
        except ValueError:
            continue
        p = j["product"] if isinstance(j.get("product"), dict) else j
        for i, v in enumerate(listed(p.get("nutrition_variants"))):
            if v is not None:
                expected.add((rid, "variant", i, text(v.get("label"))))
                expected |= {(rid, "variant_other", i, k) for k in ((v.get("nutrition") or {}).get("other") or {})}
                expected |= {(rid, "variant_size", i, text(s.get("label"))) for s in listed(v.get("sizes")) if s is not None}
        a = p.get("allergens")
        a = (json.loads(a) if isinstance(a, str) else a) or {}
        for child in ("contains", "partial"):
            expected |= {(rid, child, i, text(v.get("name") if isinstance(v, dict) else v)) for i, v in enumerate(listed(a.get(child))) if v is not None}
        expected |= {(rid, "price", i, text(v.get("date"))) for i, v in enumerate(listed(p.get("price_history"))) if v is not None}
    assert {tuple(r) for r in data_problems.p3_found(spark, FOLDER).collect()} == expected


UNITS = {"kcal": 1, "キロカロリー": 1, "kカロリー": 1, "cal": Decimal("0.001"), "kj": 1 / Decimal("4.184"), "キロジュール": 1 / Decimal("4.184"), "mj": 1000 / Decimal("4.184"), "メガジュール": 1000 / Decimal("4.184")} | {
    "g": 1000, "gram": 1000, "グラム": 1000, "mg": 1, "ミリグラム": 1, "kg": 10**6, "キログラム": 10**6, "μg": Decimal("0.001"), "mcg": Decimal("0.001"), "マイクログラム": Decimal("0.001"),
}
LABELS = {"エネルギー": "kcal", "熱量": "kcal", "カロリー": "kcal", "energy": "kcal", "たんぱく質": "protein_g", "タンパク質": "protein_g", "蛋白質": "protein_g", "protein": "protein_g", "脂質": "fat_g", "総脂質": "fat_g", "fat": "fat_g", "炭水化物": "carbs_g", "carbohydrate": "carbs_g", "食塩相当量": "salt_g", "食塩": "salt_g", "塩分": "salt_g", "salt": "salt_g", "ナトリウム": "na", "sodium": "na", "na": "na", "糖質": "sugar_g", "sugar": "sugar_g", "食物繊維": "fiber_g", "fiber": "fiber_g"}


def test_units(spark):
    fold = lambda s: re.sub(r"\s", "", unicodedata.normalize("NFKC", s or "").lower())
    unit = "|".join(sorted(UNITS, key=len, reverse=True))
    expected = {}
    for r in read("nutrition_lines"):
        m = re.match(r"^([^(\[/:]+?)(?:[(\[/](.+?)[)\]]?)?$", fold(r["nutrient_label"]))
        nutrient = m and (LABELS.get(m[1]) or LABELS.get(re.sub("[量計]$", "", m[1])))
        t = fold(r["amount_text"])
        if not nutrient or re.search(r"[<>]|未満|以下|以上|小さじ|[0-9][a-zμァ-ヴー]*[〜~-][0-9]", t):
            continue
        found = re.search(rf"([0-9][0-9,]*(?:\.[0-9]+)?)({unit})?", t.split(":")[-1])
        if t and not found:
            continue
        value = Decimal(found[1].replace(",", "")) if t else None if r["amount"] is None else Decimal(repr(r["amount"]))
        name = (found[2] if t else None) or fold(r["unit"]) or m[2]
        if value is not None and name in UNITS:
            exact = value * UNITS[name] * (Decimal("2.54") if nutrient == "na" else 1)
            expected[r["line_id"]] = ("salt_g" if nutrient == "na" else nutrient, int(exact.quantize(Decimal(1), ROUND_HALF_UP)))
    assert {r["line_id"]: (r["nutrient"], r["amount"]) for r in data_problems.p6_found(spark, FOLDER).collect()} == expected
