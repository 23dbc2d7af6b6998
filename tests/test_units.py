from menuflow.operators.units import common_units, conversions, parse_lines

SCHEMA = "line_id bigint, record_id bigint, nutrient_label string, amount_text string, amount double, unit string, notation string"
LINES = [
    ("熱量", "1163 kJ", None, None, ("kcal", 278)),
    ("エネルギー（kcal）", "約1,234.5", None, None, ("kcal", 1235)),
    ("Energy", "386,000　cal", None, None, ("kcal", 386)),
    ("カロリー", None, 5.46, "メガジュール", ("kcal", 1305)),
    ("ｴﾈﾙｷﾞｰ", "520kｶﾛﾘｰ (2175kJ)", None, None, ("kcal", 520)),
    ("熱量", "520kcal(1個242g)", None, None, ("kcal", 520)),
    ("脂 質", "５５．７", None, "ｇ", ("fat_g", 55700)),
    ("蛋白質", "0.0005g", None, None, ("protein_g", 1)),  # half a milligram is rounded up
    ("Na", "０．４㌘", None, None, ("salt_g", 1016)),
    ("Sodium(㍉㌘)", "400", None, None, ("salt_g", 1016)),
    ("糖質", "糖質：69.8 グラム ※店内計測", None, None, ("sugar_g", 69800)),
    ("食物繊維 [㎎]", "7,010前後", None, None, ("fiber_g", 7010)),
    ("塩分/µg", "1000", None, None, ("salt_g", 1)),
    ("炭水化物", None, 0.0474, "kg", ("carbs_g", 47400)),
    ("炭水化物", "12", None, None, None),
    ("炭水化物", "<5g", None, None, None),
    ("炭水化物", "5g未満", None, None, None),
    ("炭水化物", "5〜9g", None, None, None),
    ("炭水化物", "5g-9g", None, None, None),
    ("炭水化物", "小さじ1", None, None, None),
    ("炭水化物", "Tr", None, "g", None),
    ("炭水化物", "", None, "g", None),
    ("知らない", "5g", None, None, None),
    (None, "5g", None, None, None),
    ("脂質", "5 furlong", None, None, None),
]


def frame(spark, lines):
    return spark.createDataFrame([(i, i, a, b, c, d, "x") for i, (a, b, c, d, *_) in enumerate(lines)], SCHEMA)


def test_each_line(spark):
    df = frame(spark, LINES)
    found = {r["line_id"]: (r["nutrient"], r["amount"]) for r in common_units(df.union(df)).collect()}
    assert found == {i: x[4] for i, x in enumerate(LINES) if x[4]}
    assert common_units(frame(spark, [])).count() == 0


def test_an_unknown_notation_is_told_from_linked_lines(spark):
    lines = [("脂質", f"{v}mg", None, None) for v in range(1000, 1100)] + [("脂質", f"{v / 1000}zog", None, None) for v in range(1000, 1100)]
    found = {r["notation"]: r for r in conversions(parse_lines(frame(spark, lines))).collect()}
    assert found["zog"]["unit"] == "g" and found["zog"]["factor"] == 1000.0 and found["mg"]["agrees"]
    assert common_units(frame(spark, lines)).count() == 200


def linked(spark, written):
    """Records that tell one energy in two lines, the second by ``written``."""
    rows = [x for i in range(40) for x in ((2 * i, i, "熱量", f"{300 + 7 * i}kcal"), (2 * i + 1, i, "熱量", written(300 + 7 * i)))]
    return spark.createDataFrame([(*x, None, None, "x") for x in rows], SCHEMA)


def test_links_of_a_record_decide_before_the_name(spark):
    df = linked(spark, lambda v: f"{v}cal")  # as menus write it: a "Cal" that is a kcal
    told = {r["notation"]: r for r in conversions(parse_lines(df)).collect()}
    assert told["cal"]["unit"] == "kcal" and told["cal"]["links"] == 40 and not told["cal"]["agrees"]
    assert {(r["line_id"] // 2, r["amount"]) for r in common_units(df).collect()} == {(i, 300 + 7 * i) for i in range(40)}


def test_links_with_an_offset_or_too_few_do_not_decide(spark):
    told = {r["notation"]: r for r in conversions(parse_lines(linked(spark, lambda v: f"{v + 400}cal"))).collect()}
    assert told["cal"]["decided"] != "links" and told["cal"]["links"] == 0
    few = {r["notation"]: r for r in conversions(parse_lines(linked(spark, lambda v: f"{v}cal").where("record_id < 3"))).collect()}
    assert few["cal"]["unit"] == "cal" and few["cal"]["decided"] == "name"


def test_a_misleading_name_gives_way_to_a_certain_estimate(spark):
    lines = [(label, f"{v}{unit}", None, None) for label, v0 in (("脂質", 9000), ("糖質", 30_000)) for v in range(v0, v0 + 4000, 100) for unit in ("mg", "gram")]
    told = {r["notation"]: r for r in conversions(parse_lines(frame(spark, lines))).collect()}
    assert (told["gram"]["unit"], told["gram"]["decided"], told["gram"]["agrees"]) == ("mg", "level", False)


def test_a_scale_is_propagated_over_several_steps(spark):
    # each notation shares one nutrient with the next only: mg - aa - bb - cc
    steps = [("脂質", "mg", "aa", 1), ("糖質", "aa", "bb", 1000), ("食塩", "bb", "cc", 1000), ("炭水化物", "cc", "dd", 1)]
    lines = []
    for i, (label, a, b, factor) in enumerate(steps):
        for v in range(1000, 1200):
            lines += [(label, f"{v}{a}", None, None), (label, f"{v / factor:.4f}{b}", None, None)]
    told = {r["notation"]: r for r in conversions(parse_lines(frame(spark, lines))).collect()}
    assert [told[x]["unit"] for x in ("aa", "bb", "cc", "dd")] == ["mg", "g", "kg", "kg"]
    assert all(told[x]["decided"] == "level" for x in ("aa", "bb", "cc", "dd"))


def test_supported_notations_do_not_need_their_names(spark, monkeypatch):
    from menuflow.operators import units
    from menuflow.sources.tables import table

    parsed = parse_lines(table(spark, "/root/testdata/sf0.1", "nutrition_lines"))
    with_names = {(r["dimension"], r["notation"]): (r["unit"], r["decided"]) for r in conversions(parsed).collect()}
    monkeypatch.setattr(units, "NAMED", {"kcal": ("-",)})
    without = {(r["dimension"], r["notation"]): r["unit"] for r in conversions(parsed).collect()}
    assert {k for k, (_, by) in with_names.items() if by == "name"} == set()
    assert without == {k: u for k, (u, _) in with_names.items()}


def test_two_amounts_of_a_line_link_their_notations(spark):
    lines = [("熱量", f"{v}kcal({v * 4.184:.0f}zog)", None, None) for v in range(300, 340)] + [("熱量", "4184zog", None, None)]
    told = {r["notation"]: r for r in conversions(parse_lines(frame(spark, lines))).collect()}
    assert told["zog"]["unit"] == "kJ" and told["zog"]["links"] == 40 and told["zog"]["support"] == 1
    assert {r["line_id"]: r["amount"] for r in common_units(frame(spark, lines)).collect()}[40] == 1000
