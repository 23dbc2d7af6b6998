import json

from pyspark.sql import functions as F

from menuflow.operators import extract as X

GRID = (
    "<div class='product-list-card grid-item-inner'><a data-product-code='6900' href='/products/6900/'></a><img data-time-limited-offer='true' data-time-limited-offer-started-at='2026-03-01T00:00:00' class='badge absolute'>"
    "<strong class='product-list-card-name x'>チーズ&amp;<br>バーガー</strong><span class='product-list-card-price-number y'>460~</span></div>"
    "<!-- <div class='product-list-card '><a data-product-code='0'> -->"
    "<div class='product-list-card grid-item-inner'><a data-product-code='6901' href='/products/6901/'></a><img data-time-limited-offer='true' class='badge absolute hidden'><strong class='product-list-card-name'>ポテト</strong></div>"
    "<div class='product-list-card '>notice</div>"
)


def pages(spark, *bodies):
    return spark.createDataFrame([(f"u{i}", b) for i, b in enumerate(bodies)], "url string, body string")


def test_card_grid(spark, rows):
    found = X.cards(pages(spark, GRID, "", None), X.CARD_GRID, keep=["url"])
    assert rows(found.select("url", "card_ord", "product_id", "name", "price", "started", "limited", "detail_url")) == [
        ("u0", 0, "6900", "チーズ&\nバーガー", 460, "2026-03-01", True, "/products/6900/"),
        ("u0", 1, "6901", "ポテト", None, None, False, "/products/6901/"),
    ]


def item(pid, name, price, *badges):
    icons = "".join(f'<span class="menu-icon__txt">{b}</span>' for b in badges)
    return f'<li class="menu-list__item"><a href="/x/menu/{pid}/">{icons}<h3 class="menu-list__name">{name}</h3><span class="menu-price__number--x">{price}</span><p class="menu-price__tax">税込￥1,{price}</p></a></li>'


def test_sections_and_priority(spark, rows):
    html = '<section class="menu-list__section a"><h2 class="menu-list__ttl">期間限定</h2>' + item("1", "A", 100, "NEW", "限定") + item("2", "B", 200) + '</section><section class="menu-list__section b"><h2 class="menu-list__ttl">丼</h2>' + item("1", "A", 100) + "</section>"
    found = X.cards(pages(spark, html), X.SECTION_LIST, keep=["url"])
    assert rows(found.select("section", "product_id", "price", "price_ex_tax", F.array_join("badges", ","))) == [("丼", "1", 1100, 100, ""), ("期間限定", "1", 1100, 100, "NEW,限定"), ("期間限定", "2", 1200, 200, "")]
    assert rows(X.first_by_priority(found, keys=["product_id"], low="期間限定").select("product_id", "section", "in_low")) == [("1", "丼", True), ("2", "期間限定", True)]


def test_lists_and_tables(spark, rows):
    tabs = '<section class="c-menuListWrap"><h2 class="z">麺</h2><li class="c-menuListItem"><a href="../info.html?id=161"><p class="c-menuListTitle">炒め</p><span class="c-menuListPriceNum">1,590</span><li class="menuListTagItem">15:00から</li></a></li></section>'
    assert rows(X.cards(pages(spark, tabs), X.TAB_LIST).select("section", "product_id", "name", "price", F.array_join("notes", "|"))) == [("麺", "161", "炒め", 1590, "15:00から")]
    pics = '<li>\n<a href="/ja/menu/1/detail/64.html"><dl><dd><span>そば</span><br/><span>420</span> <span class="yen">円</span></dd></dl></a></li><li>\n<a href="/ja/menu/1/detail/808-1.html"><dl><dd><span>砂肝</span></dd></dl></a></li>'
    assert rows(X.cards(pages(spark, pics), X.PICTURE_LIST).select("product_id", "name", "price")) == [("64", "そば", 420), ("808-1", "砂肝", None)]
    dl = '<dl><dt class="menuDataTableTitle">熱量</dt><dd class="menuDataTableText">639Kcal</dd></dl><dl><dt class="menuDataTableTitle">卵</dt><dd class="menuDataTableText">●</dd></dl><dl><dt class="menuDataTableTitle">熱量</dt><dd class="menuDataTableText">640</dd></dl>'
    assert pages(spark, dl).select(X.labelled(F.col("body"), X.DEFINITION_ROWS).alias("m")).collect()[0]["m"] == {"熱量": "640", "卵": "●"}
    tr = "<table><tr><th>カロリー</th><td><span>636</span>kcal</td></tr></table>"
    assert pages(spark, tr).select(X.labelled(F.col("body"), X.TABLE_ROWS).alias("m")).collect()[0]["m"] == {"カロリー": "636kcal"}


def test_json_forms(spark, rows):
    island = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"name":"うどん"}}}</script>'
    got = pages(spark, island, "<p>", None).select(X.json_island(F.col("body"), "props struct<pageProps:struct<name:string>>")["props"]["pageProps"]["name"].alias("n"))
    assert sorted(r["n"] or "" for r in got.collect()) == ["", "", "うどん"]
    menu = {"header": {"result": True}, "body": {"allMenuList": [{"menuCategoryNm": "おすすめ", "menuInfo": [{"menuCd": "1", "menuNm": "A", "dineInPrc": "2,490"}, {"menuCd": "2", "menuNm": "Aセット", "dineInPrc": "1"}]}, {"menuCategoryNm": "他", "menuInfo": [{"menuCd": "1", "menuNm": "A", "dineInPrc": "2490"}]}]}}
    good, bad = X.envelope(pages(spark, json.dumps(menu), json.dumps({"header": {"result": False}, "body": {}}), "nonsense", None), X.MENU_BODY, keep=["url"])
    assert rows(bad.select("url", "reason")) == [("u1", "envelope"), ("u2", "envelope"), ("u3", "envelope")]
    assert rows(X.api_menu(good, keep=["url"]).select("product_id", "name", "price", "section", "in_low")) == [("1", "A", 2490, "他", True)]


def test_news_periods_and_variants(spark, rows):
    li = '<li class="information__item"><a href="{l}"><time datetime="x">{d}</time><span class="information__txt--k">{t}</span></a></li>'
    html = li.format(l="/a", d="2026.03.01", t="「丼」新発売") + li.format(l="/a", d="2026.03.01", t="「丼」新発売") + li.format(l="/b", d="2026.02.30", t="?")
    found = X.news_rows(pages(spark, html), item=r'<li class="information__item">', date=r"<time[^>]*>([0-9.]+)<", title=r"information__txt--k\">(.*?)</span>", link=r'href="([^"]+)"')
    assert rows(found.select(F.col("date").cast("string"), "title", "link", "ord")) == [("2026-03-01", "「丼」新発売", "/a", 0)]
    got = spark.range(1).select(X.sales_period(F.lit("【2026年3月1日〜なくなり次第】")).alias("p"), X.sales_period(F.lit("x")).alias("q")).collect()[0]
    assert str(got["p"]["start"]) == "2026-03-01" and got["p"]["end_text"] == "なくなり次第" and got["q"]["start"] is None
    v = spark.createDataFrame([([("大", 3), ("並", 2), (None, 1)],), ([("大", 3), ("中並", 2)],), ([("大", 3)],), ([],)], "v array<struct<label:string,price:int>>")
    labels = [r["l"] for r in v.select(X.primary_variant(F.col("v"), ["並", ""])["price"].alias("l")).collect()]
    assert labels == [2, 2, 3, None]
    assert [r["n"] for r in v.select(F.size(X.variant_prices(F.col("v"), "並")).alias("n")).collect()] == [3, 2, None, None]
    images = spark.createDataFrame([([("full", 900, "a"), ("medium", 320, "b")],), ([("full", 900, "a"), ("big", 800, "c")],), ([("s", 100, "d")],)], "i array<struct<size:string,width:int,url:string>>")
    assert [r["u"] for r in images.select(X.thumbnail(F.col("i"), ["medium"]).alias("u")).collect()] == ["b", "c", "d"]
