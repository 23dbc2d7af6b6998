import datetime as dt

from pyspark.sql import functions as F

from menuflow.operators import gates, geometry, match, merge, products, views


def test_upsert_and_baseline(spark, rows):
    stored = spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "c string, k int, p int")
    today = spark.createDataFrame([("a", 2, 25), ("a", 3, 30)], "c string, k int, p int")
    up = {"p": F.coalesce("t.p", "s.p")}
    assert rows(merge.upsert(stored, today, keys=["c", "k"], update=up)) == [("a", 1, 10, "missing"), ("a", 2, 25, "update"), ("a", 3, 30, "insert")]
    assert rows(merge.upsert(stored, today, keys=["c", "k"], update=up, absent_counts=F.lit(False)))[0] == ("a", 1, 10, "keep")
    more = today.union(spark.createDataFrame([("b", 9, 1)], today.schema))
    assert rows(merge.new_against(more, stored, scope=["c"], key="k").select("c", "k")) == [("a", 3)]  # b has no baseline: nothing is new
    assert rows(merge.dead_letters(stored, today, stored.where("k = 1"), keys=["c", "k"])) == [("a", 2, 25), ("a", 3, 30)]


def test_merging_and_moves(spark, rows):
    r = spark.createDataFrame([("k", 1, True, None, ["b"]), ("k", 2, None, "x", ["a", "b"]), ("k", 3, False, "y", None)], "k string, o int, f boolean, v string, s array<string>")
    assert rows(merge.merge_pages(r, keys=["k"], order=["o"], flags=["f"], firsts=["v"], sets=["s"])) == [("k", True, "x", ["a", "b"])]
    gone = spark.createDataFrame([("s", "a1"), ("t", "a2"), ("t", "a3")], "slug string, k string")
    fresh = spark.createDataFrame([("s", "b1"), ("t", "b2")], "slug string, k string")
    assert rows(merge.mutual_moves(gone, fresh, by=["slug"], key="k")) == [("s", "a1", "b1")]
    m = spark.createDataFrame([("k", 1, 9, None, "z", True), ("k", 2, 3, "q", None, False)], "k string, born int, seen int, a string, b string, on boolean")
    assert rows(merge.merge_rekeyed(m, keys=["k"], born="born", seen="seen", oldest=["a"], newest=["b"], any_of=["on"])) == [("k", 2, 1, 9, "q", "z", True)]
    assert [r[0] for r in spark.range(1).select(merge.classify(F.lit(None).cast("boolean"), F.lit(False), F.lit(False), F.lit(True))).collect()] == ["new"]


def test_matching(spark, rows):
    names = spark.createDataFrame([(1, "abcdefg"), (2, "short"), (3, "abcdefzz")], "n int, name string")
    texts = spark.createDataFrame([(1, "xxabcdefgyyabcdefg"), (2, "abcdef"), (3, None), (4, "short")], "t int, text string")
    assert rows(match.contained_in(names, texts, name="name", text="text", name_keys=["n"], text_keys=["t"])) == [(1, 1)]
    day = lambda n: dt.date(2026, 1, n)
    items = spark.createDataFrame([("a", "x", day(1)), ("b", "y", day(1)), ("c", "z", day(1))], "k string, name string, ref date")
    events = spark.createDataFrame([("x", day(5), 1, False), ("x", day(5), 2, False), ("y", day(5), 3, False), ("y", day(6), 4, False), ("z", day(9), 5, True), ("z", day(5), 6, False)], "name string, e date, id int, open boolean")
    assert rows(match.unique_end(items, events, on=["name"], keys=["k"], reference="ref", end="e", is_open=F.col("open"), event_id="id")) == [("a", day(5), 2)]
    values = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2)], "name string, v int")
    assert rows(match.unless_ambiguous(items.select("name"), values, on=["name"], values=["v"])) == [("x", 1)]


def test_gates(spark, rows):
    got = spark.range(1).select(gates.energy_ok(F.lit(10), F.lit(10), F.lit(10), F.lit(170)), gates.energy_ok(F.lit(10), F.lit(10), F.lit(10), F.lit(300)), gates.energy_ok(F.lit(None).cast("int"), F.lit(1), F.lit(1), F.lit(1))).collect()[0]
    assert tuple(got) == (True, False, None)
    s = spark.createDataFrame([("a", "v2"), ("b", "v1"), ("c", None), ("d", "bad"), ("e", None)], "id string, sig string")
    st = spark.createDataFrame([("a", "v1", dt.date(2026, 1, 1), None), ("b", "v1", dt.date(2026, 1, 1), None), ("c", None, dt.date(2026, 1, 1), None), ("d", "v1", None, "bad"), ("e", None, dt.date(2026, 1, 9), None)], "id string, sig string, checked date, bad_signature string")
    assert rows(gates.sources_to_read(s, st, key="id", signature="sig", checked="checked", today=F.to_date(F.lit("2026-01-10")))) == [("a", "changed"), ("c", "unsigned")]
    c = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("t", 3, True), ("t", 4, True), ("t", 5, False)], "s string, n int, ok boolean")
    assert rows(gates.abort_if_half_fail(c, keys=["s"], ok="ok").select("n")) == [(3,), (4,)]


def test_page_geometry(spark, rows):
    p = spark.createDataFrame([("p", x) for x in (1.0, 2.0, 9.0, 9.5, 20.0)], "page string, x double")
    assert rows(geometry.clusters(p, keys=["page"], value="x", tolerance=3.0).select("cluster", "n", "centre")) == [(0, 2, 1.5), (1, 2, 9.25), (2, 1, 20.0)]
    assert [r[0] for r in p.select(geometry.band_of(F.col("x"), [0, 2, 9.5])).collect()] == [0, 1, 1, None, None]
    bands = spark.createDataFrame([("p", 0, 0.0, 9.0), ("p", 1, 9.0, 15.0)], "page string, band int, lo double, hi double")
    assert rows(geometry.assign_bands(p, bands, keys=["page"], value="x", low="lo", high="hi", width=4.0).select("x", "band")) == [(1.0, 0), (2.0, 0), (9.0, 1), (9.5, 1)]
    t = spark.createDataFrame([("p", "n1", 1.4), ("p", "n2", 13.0)], "page string, name string, at double")
    assert rows(geometry.nearest(p, t, keys=["page"], point="x", value="x", target="name", at="at", most=7.0).select("x", "name")) == [(1.0, "n1"), (2.0, "n1"), (20.0, "n2"), (9.0, "n2"), (9.5, "n2")]
    marks = spark.createDataFrame([(1, 10.0, "●"), (1, 31.0, "△"), (2, 19.0, "○"), (2, 90.0, "?")], "row int, x double, mark string")
    cols = spark.createDataFrame([("egg", 11.0), ("milk", 20.0), ("wheat", 30.0)], "name string, x double")
    assert rows(geometry.mark_matrix(marks, cols, row=["row"], x="x", names=["egg", "milk", "wheat"])) == [(1, "●", None, "△"), (2, None, "○", None)]


def test_views(spark):
    got = spark.range(1).select(views.json_ld(name=F.lit("a<b")), views.page_description(F.array(F.lit("あああ"), F.lit("いいい")), F.lit("x:"), 7), views.feed_xml(F.lit("a&b"), F.lit("/u"), F.lit("2026-01-02 03:04:05").cast("timestamp"), F.lit("d"))).collect()[0]
    assert got[0] == '{"name":"a\\u003cb"}' and got[1] == "x:あああ"
    assert got[2] == "<item><title>a&amp;b</title><link>/u</link><pubDate>Fri, 02 Jan 2026 03:04:05 +0900</pubDate><description>d</description></item>"


def test_building_and_kinds(spark):
    e = spark.createDataFrame([("a", "1", "n", 100), ("a", "2", "m", None)], "chain string, product_id string, name string, price int")
    d = spark.createDataFrame([("a", "1", 110, "text")], "chain string, product_id string, price int, description string")
    now, today = F.lit("2026-01-02 03:00:00").cast("timestamp_ntz"), F.lit("2026-01-02").cast("date")
    got = {r["product_id"]: r for r in products.build(e, d, keys=["chain", "product_id"], now=now, today=today).collect()}
    assert got["1"]["price"] == 110 and [tuple(h) for h in got["1"]["price_history"]] == [("2026-01-02", 110, None)] and got["2"]["price_history"] == [] and got["2"]["status"] == "on_sale"
    p = spark.createDataFrame([("1", None, "限定", "2026-01-01", "news"), ("2", True, None, None, None)], "id string, is_regular boolean, limited_kind string, launch_date string, launch_date_source string")
    m = {r["id"]: r for r in products.mark_regular(p, F.col("id") == "1").collect()}
    assert m["1"]["is_regular"] and m["1"]["limited_kind"] is None and m["2"]["is_regular"] is None
    u = {r["id"]: r for r in products.upgrade_regular(p, F.lit(True), F.lit("数量限定")).collect()}
    assert u["2"]["limited_kind"] == "数量限定" and u["2"]["is_regular"] is None and u["1"]["limited_kind"] == "限定"
    assert [products.FAMILIES[f].price_gated for f in ("list_html", "form_api")] == [True, False]


def test_history_and_seasons(spark):
    day = F.lit("2026-05-01").cast("date")
    h = spark.createDataFrame([(1, [("2026-01-01", 5, None)], 5, "2025-12-01", dt.date(2026, 4, 1), "ended", None), (2, [], 7, None, None, "on_sale", None)], "id int, price_history array<struct<date:string,price:int,relaunch:boolean>>, price int, launch_date string, ended_observed_at date, status string, seasons array<struct<launch_date:string,ended:string>>")
    got = [r["n"] for p in (5, 6, None) for r in h.where("id = 1").select(F.size(products.append_price(F.col("price_history"), day, F.lit(p).cast("int"))).alias("n")).collect()]
    assert got == [1, 2, 1]
    s = {r["id"]: r for r in products.new_season(h, F.col("status") == "ended", day).collect()}
    assert s[1]["status"] == "on_sale" and s[1]["launch_date"] is None and [tuple(x) for x in s[1]["seasons"]] == [("2025-12-01", "2026-04-01")] and s[1]["price_history"][-1]["relaunch"]
    assert s[2]["seasons"] is None and s[2]["price_history"] == []
    again = products.new_season(products.new_season(h, F.col("id") == 1, day), F.col("id") == 1, day).where("id = 1").collect()[0]
    assert sum(bool(x["relaunch"]) for x in again["price_history"]) == 1


def test_variants(spark, rows):
    v = spark.createDataFrame([([("単品", 5), (None, 8)], [("単品", 5), ("大", 9)])], "a array<struct<label:string,price:int>>, b array<struct<label:string,price:int>>")
    got = v.select(products.relabel_variants(F.col("a")).alias("r"), products.with_takeout(F.col("a"), F.col("b")).alias("t")).collect()[0]
    assert [tuple(x) for x in got["r"]] == [("単品", 5), ("セット（単品を含む）", 8)] and [tuple(x) for x in got["t"]][2:] == [("大（持ち帰り）", 9)]
    s = spark.createDataFrame([("k", 1, [("a", 1), ("b", 2)]), ("k", 2, [("b", 2), ("a", 1)]), ("k", 3, [("a", 1)]), ("k", 4, [("a", 1), ("b", 3)])], "k string, t int, v array<struct<label:string,price:int>>")
    assert [r["t"] for r in products.variant_changes(s, keys=["k"], at="t", variants="v").collect()] == [4]
    t = spark.createDataFrame([("x", "大盛", 9.0), ("x", "並盛", 5.0), ("x", "小", None), ("y", "大盛", 3.0)], "k string, size string, kcal double")
    assert rows(products.representative(t, keys=["k"], size="size", values=["kcal"]).select("k", "kcal", F.size("variants"), "dropped")) == [("x", 5.0, 2, 1), ("y", 3.0, None, 0)]
    m = spark.createDataFrame([("x", "egg", "△"), ("x", "egg", "●"), ("x", "milk", "△"), ("x", "soy", None)], "k string, n string, m string")
    assert rows(products.allergens(m, keys=["k"], name="n", mark="m")) == [("x", ["egg"], ["milk"])]
    assert spark.range(1).select(products.price_note((F.lit(True), "a"), (F.lit(False), "b"), (F.lit(True), "c"))).collect()[0][0] == "ac"


def test_launches_and_reviews(spark, rows):
    day = lambda m, d: dt.date(2026, m, d)
    items = spark.createDataFrame([("c", "1", "試作しょうが丼", day(3, 10)), ("c", "2", "試作えび餃子", day(3, 10)), ("c", "3", "試作ごま麺", day(3, 10))], "chain string, id string, name string, ref date")
    news = spark.createDataFrame(
        [("c", day(3, 1), "「試作しょうが丼（大）・試作えび餃子」3月5日より新発売！"), ("c", day(3, 2), "「試作しょうが丼」販売終了、新発売もあり"), ("c", day(3, 8), "本日、試作ごま麺登場"), ("c", day(6, 1), "「試作えび餃子」新発売"), ("d", day(3, 1), "「試作えび餃子」新発売")],
        "chain string, date date, title string",
    )
    how = {"scope": ["chain"], "key": "id", "name": F.col("name"), "reference": "ref", "title": "title", "date": "date", "words": "発売|登場", "no_words": "終了"}
    found = match.launches(items, news, **how, split="・", drop_brackets=True)
    assert rows(found.select("id", "date", "launch")) == [("1", day(3, 1), day(3, 5)), ("2", day(3, 1), day(3, 5)), ("3", day(3, 8), day(3, 8))]
    reviews = spark.createDataFrame([("c", 1, "試作しょうが丼", day(3, 12)), ("c", 2, "期間限定の試作しょうが丼を食べた", day(3, 12)), ("c", 3, "試作", day(3, 12)), ("c", 4, "試作しょうが丼", day(1, 1)), ("c", 5, "試作ごま", day(3, 12))], "chain string, rid int, dish string, date date")
    linked = match.review_links(items, reviews, scope=["chain"], key="id", name=F.col("name"), launch="ref", review="rid", review_name=F.col("dish"), date="date")
    assert rows(linked.select("id", "rid")) == [("1", 1), ("1", 2)]


def test_nearest_neighbours_do_not_depend_on_bins(spark, rows):
    import random

    rnd = random.Random(1)
    data = [(rnd.choice("aab"), i, float(rnd.randint(0, 40))) for i in range(200)] + [("z", 1, 1.0)]
    expected = []
    for s in "abz":
        r = sorted((v, k) for c, k, v in data if c == s and v is not None)
        for v, k in r:
            near = sorted((abs(x - v), y) for x, y in r if y != k)[:3]
            expected += [(s, k, y, d, n) for n, (d, y) in enumerate(near, 1)]
    df = spark.createDataFrame(data, "s string, k int, v double")
    for per_bin in (1000, 4):
        assert sorted(rows(match.nearest(df, scope=["s"], value="v", key="k", k=3, per_bin=per_bin, bins=7))) == sorted(expected)


def test_nearest_of_many_equal_values(spark, rows):
    data = [("s", i, 5.0) for i in range(1, 31)] + [("s", 40 + i, float(i)) for i in range(11)] + [("s", 100 + i, 7.0) for i in range(12)]
    some = [*data, ("t", 1, 2.0), ("t", 2, None), ("t", 3, None), ("t", 4, 9.0), ("t", None, 2.0)]
    expected = []
    for s, key, v in (x for x in some if x[1] is not None):
        others = sorted((v is None or b is None, 0.0 if v is None or b is None else abs(b - v), k) for t, k, b in some if t == s and k not in (None, key))
        expected += [(s, key, k, None if far else d, i + 1) for i, (far, d, k) in enumerate(others[:3])]
    df = spark.createDataFrame(some, "s string, k int, v double")
    for bins in (1, 7):
        found = rows(match.nearest(df, scope=["s"], value="v", key="k", k=3, bins=bins))
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_launches_form_no_pairs_of_equal_rows(spark, rows, tmp_path):
    day = lambda n: dt.date(2026, 3, n)
    many = [("c", i, "試作しょうが丼", day(1 + i % 3)) for i in range(300)] + [("c", 400, "試作ごま麺", day(20)), ("c", 400, "試作えび餃子", None), ("c", None, "試作ごま麺", day(20)), (None, 1, "試作ごま麺", day(20)), ("c", 401, None, day(20))]
    told = [("c", day(9), "3月10日「試作しょうが丼」を発売")] * 300 + [("c", day(2), "「試作しょうが丼」新発売"), ("c", day(21), "新登場の試作ごま麺"), ("c", day(22), "新登場の試作ごま麺"), ("c", day(29), "新登場の試作ごま麺"), (None, day(21), "新登場の試作ごま麺")]
    spark.createDataFrame(many, "chain string, id int, name string, ref date").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame(told, "chain string, date date, title string").write.parquet(f"{tmp_path}/news")
    items, news = spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/news")
    common = {"scope": ["chain"], "key": "id", "name": F.col("name"), "reference": "ref", "date": "date", "words": "発売|登場"}
    found = match.launches(items, news, **common, title="title", no_words="終了", strict=3)
    bodies = match.body_launches(items, news, found, **common, body="title")
    for df in (found, bodies):  # rows of packed files aren't sent to the driver
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("c", i, day(9), "3月10日「試作しょうが丼」を発売", day(10)) for i in range(300)]
    assert rows(bodies) == [("c", 400, day(22)), ("c", None, day(22))]
    joined = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in node.nodeName():
            joined.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(found._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= 300


def test_nearest_targets_of_crowded_positions(spark, rows):
    import random

    rnd = random.Random(2)
    points = [(rnd.choice("ab"), i % 350, rnd.choice((None, float("nan"), float("inf"), 0.0, -0.0, 1e300, *(rnd.randint(-90, 90) / 2 for _ in range(30))))) for i in range(400)] + [(None, 1, 1.0), ("c", 1, 1.0)]
    targets = [(rnd.choice("ab"), i, rnd.choice((None, float("nan"), float("inf"), 1e300, *(rnd.randint(-40, 40) * 1.5 for _ in range(30))))) for i in range(300)] + [(None, 1, 1.0), ("a", None, 1.25)]
    expected = {}
    for s, p, v in points:
        near = [(abs(v - x), t is None, t or 0) for k, t, x in targets if s is not None and k == s and v is not None and x is not None and abs(v - x) <= 7.0]
        if near:
            expected[s, p] = min(expected.get((s, p), min(near)), min(near))
    p, t = spark.createDataFrame(points, "k string, p int, v double"), spark.createDataFrame(targets, "k string, t int, x double")
    how = {"keys": ["k"], "point": "p", "value": "v", "target": "t", "at": "x", "most": 7.0}
    assert rows(geometry.nearest(p, t, **how)) == sorted(((s, k, None if n else i, d) for (s, k), (d, n, i) in expected.items()), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert "Join" not in geometry.nearest(p, t, **how)._jdf.queryExecution().executedPlan().toString()  # no pairs of points and targets


def test_review_counts_without_pairs(spark, rows):
    import random

    import __spark_entry__ as entry

    rnd = random.Random(3)
    day = lambda: rnd.choice((None, *(dt.date(2026, 1 + m, 1 + n) for m in range(3) for n in range(0, 28, 5))))
    names = ["試作しょうが丼", "しょうが丼", "試作 しょうが丼（大）", "ABCDEF", "abc-def", "xabcdefg", "abc", "試作ごま", "", None, "・"]
    items = [(rnd.choice("cd"), rnd.choice((None, *range(60))), rnd.choice(names), day()) for _ in range(120)] + [(None, 1, "abcdef", None)]
    reviews = [(rnd.choice("cd"), rnd.choice((None, *range(50))), rnd.choice(names), day()) for _ in range(120)] + [(None, 1, "abcdef", None)]
    plain = lambda x: None if x is None else x.lower().translate({ord(c): None for c in " -・（）"})
    pairs = set()
    for s, i, n, launched in items:
        for t, r, m, told in reviews:
            a, b = plain(n), plain(m)
            alike = s is not None and s == t and a and b and (a == b or (len(a) >= 6 and a in b) or (len(b) >= 6 and b in a))
            if alike and not (launched and told and (launched - told).days > 14):
                pairs.add((s, i, r))
    by = {}
    for s, i, r in pairs:
        by.setdefault((s, i), []).append(r)
    expected = [(s, i, len(r), min((x for x in r if x is not None), default=None), max((x for x in r if x is not None), default=None)) for (s, i), r in by.items()]
    order = lambda t: tuple((x is None, str(x)) for x in t)
    a, b = spark.createDataFrame(items, "s string, i int, n string, l date"), spark.createDataFrame(reviews, "s string, r int, m string, d date")
    how = {"scope": ["s"], "key": "i", "name": F.col("n"), "launch": "l", "review": "r", "review_name": F.col("m"), "date": "d"}
    assert rows(match.review_links(a, b, **how)) == sorted(pairs, key=order)
    assert rows(match.review_counts(a, b, **how)) == sorted(expected, key=order)
    assert "Broadcast" not in entry.queries()["review_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
