"""Queries of the extractors, over pages and answers that are put together from table rows, and of the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.functions import dates, text
from menuflow.operators import extract, gates, geometry, products
from menuflow.plans.registry import Registry
from menuflow.sources import landed
from menuflow.sources.tables import table

R = Registry()


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _page(rows: DataFrame, by: list[str], piece: Column, order: str) -> DataFrame:
    """(by, body): one page for each ``by``, of its rows' pieces in order."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"]), "\n").alias("body"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.floor("p_retailprice").cast("int").alias("price"))


_P = "p AS (SELECT p_brand AS brand, p_partkey AS k, p_name AS name, p_type AS kind, p_size AS size, floor(p_retailprice)::int AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ord FROM part)"


@R.add(f"WITH {_P} SELECT brand, k::varchar AS product_id, name, price, CASE WHEN kind = 'PROMO' THEN '2026-03-01' END AS started, kind = 'PROMO' AS limited, '/menu/' || k || '/' AS detail_url, ord AS card_ord FROM p")
def page_cards(spark: SparkSession, d: str) -> DataFrame:
    """Listing pages of cards, with comments that hold cards of their own."""
    started = F.when(F.col("kind") == "PROMO", F.lit(" data-time-limited-offer-started-at='2026-03-01'")).otherwise("")
    card = _say("<div class='product-list-card x' data-product-code='", F.col("k"), "'", started, "><a href='/menu/", F.col("k"), "/'><strong class='product-list-card-name'>", F.regexp_replace("name", " ", " <br> "), "</strong>",
                "<!-- <div class='product-list-card ' data-product-code='old'> --><span class='product-list-card-price-number'>", F.format_number("price", 0), "</span></a></div>")
    pages = _page(_parts(spark, d), ["brand"], card, "k")
    found = extract.cards(pages, extract.CARD_GRID, keep=["brand"])
    name = F.regexp_replace("name", r"\s+", " ")
    return found.select("brand", "product_id", name.alias("name"), "price", "started", "limited", "detail_url", (F.col("card_ord")).alias("card_ord")).withColumn("card_ord", F.col("card_ord") + 1)


@R.add(f"""WITH {_P}, s AS (SELECT *, CASE WHEN kind IN ('PROMO', 'LARGE') THEN 'おすすめ' ELSE kind END AS section FROM p), e AS (SELECT brand, k, name, section FROM s UNION ALL SELECT brand, k, name, 'おすすめ' FROM p WHERE kind = 'SMALL')
    SELECT brand, k::varchar AS product_id, any_value(name) AS name, coalesce(max(section) FILTER (section <> 'おすすめ'), 'おすすめ') AS section, bool_or(section = 'おすすめ') AS in_low FROM e GROUP BY brand, k""")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pages of sections; an item that is also recommended counts in its own section."""
    p = _parts(spark, d)
    low = p.where("kind in ('PROMO', 'LARGE', 'SMALL')").withColumn("section", F.lit("おすすめ"))
    rows = p.where("kind not in ('PROMO', 'LARGE')").withColumn("section", F.col("kind")).unionByName(low)
    item = _say('<li class="c-menuListItem"><a href="/item?id=', F.col("k"), '"><p class="c-menuListTitle">', F.col("name"), '</p><span class="c-menuListPriceNum">', F.col("price"), "</span></a></li>")
    sections = _page(rows, ["brand", "section"], item, "k")
    page = _page(sections, ["brand"], _say('<section class="c-menuListWrap"><h2>', F.col("section"), "</h2>", F.col("body"), "</section>"), "section")
    found = extract.cards(page, extract.TAB_LIST, keep=["brand"])
    return extract.first_by_priority(found, keys=["brand", "product_id"], low="おすすめ").select("brand", "product_id", "name", "section", "in_low")


@R.add(f"""WITH {_P} SELECT brand, k::varchar AS product_id, name, price, CASE WHEN kind = 'PROMO' THEN '期間限定' ELSE '' END AS badges FROM p""")
def page_badges(spark: SparkSession, d: str) -> DataFrame:
    badge = F.when(F.col("kind") == "PROMO", F.lit('<span class="menu-icon__txt">期間限定</span>')).otherwise("")
    item = _say('<li class="menu-list__item"><a href="/menu/', F.col("k"), '/"><h3 class="menu-list__name">', F.col("name"), "</h3>", badge, '<p class="menu-price__tax">税込 ', F.format_number("price", 0), "円</p></a></li>")
    page = _page(_parts(spark, d), ["brand"], item, "k").withColumn("body", _say('<section class="menu-list__section"><h2 class="menu-list__ttl">一品</h2>', F.col("body"), "</section>"))
    return extract.cards(page, extract.SECTION_LIST, keep=["brand"]).select("brand", "product_id", "name", "price", F.array_join("badges", ",").alias("badges"))


@R.add(f"""WITH {_P} SELECT k, name, price::double AS kcal, size::double / 10 AS salt, kind AS note FROM p""")
def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Detail pages with a table of labels and values; a label that stands twice keeps its last value."""
    rows = _say("<table><tr><th>エネルギー</th><td>0kcal</td></tr><tr><th>エネルギー</th> <td>", F.format_number("price", 0), " kcal</td></tr><tr><th>食塩相当量</th><td>", F.col("size") / 10, "g</td></tr><tr><th>備考</th><td><b>", F.col("kind"), "</b></td></tr></table>")
    page = _parts(spark, d).select("k", _say("<h1>", F.col("name"), "</h1>", rows).alias("body"))
    told = page.select("k", extract.Field("name", r"<h1>(.*?)</h1>").column(F.col("body")), extract.labelled(F.col("body"), extract.TABLE_ROWS).alias("m"))
    return told.select("k", "name", text.to_number(F.col("m")["エネルギー"]).alias("kcal"), text.split_unit(F.col("m")["食塩相当量"])["number"].alias("salt"), F.col("m")["備考"].alias("note"))


@R.add("""SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS title, '/n/' || (o_orderkey) AS link FROM orders WHERE o_orderstatus <> 'P'""")
def page_news(spark: SparkSession, d: str) -> DataFrame:
    """News listings with dates in two notations; items without a readable date are dropped, repeated ones count once."""
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderstatus") == "P", F.lit("近日公開")).when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    item = _say('<li class="news"><time>', day, '</time><a href="/n/', F.col("o_orderkey"), '">', F.col("o_orderpriority"), "</a></li>")
    page = _page(o.withColumn("k", F.col("o_custkey")), ["k"], F.concat(item, item), "o_orderkey")
    found = extract.news_rows(page, item=r'<li class="news">', date=r"<time>(.*?)</time>", title=r'<a [^>]*>(.*?)</a>', link=r'href="([^"]+)"', keep=["k"])
    return found.select("k", F.col("date").cast("string").alias("date"), "title", "link")


@R.add(f"""WITH {_P} SELECT brand, count(*) AS items, sum(price)::bigint AS total, max(name) AS last FROM p GROUP BY 1""")
def json_islands(spark: SparkSession, d: str) -> DataFrame:
    items = _parts(spark, d).groupBy("brand").agg(F.to_json(F.struct(F.collect_list(F.struct("name", "price")).alias("items"))).alias("j"))
    page = items.select("brand", _say('<html><script id="__NEXT_DATA__" type="application/json">', F.col("j"), "</script></html>").alias("body"))
    found = page.select("brand", F.inline(extract.json_island(F.col("body"), "items array<struct<name:string,price:int>>")["items"]))
    return found.groupBy("brand").agg(F.count(F.lit(1)).alias("items"), F.sum("price").alias("total"), F.max("name").alias("last"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("k").cast("string").alias("menuCd"), F.when(F.col("kind") == "LARGE", F.concat("name", F.lit("セット"))).otherwise(F.col("name")).alias("menuNm"), F.format_number("price", 0).alias("dineInPrc"))
    cats = _parts(spark, d).groupBy("brand", F.when(F.col("kind") == "PROMO", "おすすめ").otherwise(F.col("kind")).alias("menuCategoryNm")).agg(F.collect_list(item).alias("menuInfo"))
    body = F.struct(F.array_sort(F.collect_list(F.struct("menuCategoryNm", "menuInfo"))).alias("allMenuList"))
    good = cats.groupBy("brand").agg(F.to_json(F.struct(F.struct(F.lit(True).alias("result")).alias("header"), body.alias("body"))).alias("body"))
    bad = cats.select("brand").distinct().select("brand", F.lit('{"header": {"result": false}, "body": null}').alias("body"))
    return good.unionByName(bad)


@R.add(f"WITH {_P} SELECT brand, k::varchar AS product_id, name, price, CASE WHEN kind = 'PROMO' THEN 'おすすめ' ELSE kind END AS section FROM p WHERE kind <> 'LARGE'")
def api_menus(spark: SparkSession, d: str) -> DataFrame:
    good, _ = extract.envelope(_answers(spark, d), extract.MENU_BODY, keep=["brand"])
    return extract.api_menu(good, keep=["brand"]).select("brand", "product_id", "name", "price", "section")


@R.add("SELECT DISTINCT p_brand AS brand, 'envelope' AS reason FROM part")
def api_failures(spark: SparkSession, d: str) -> DataFrame:
    """Answers that say failure, with their reason, for the dead letters."""
    return extract.envelope(_answers(spark, d), extract.MENU_BODY, keep=["brand"])[1]


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one name and brand as variants, labelled by type; the smallest price of a label."""
    each = _parts(spark, d).groupBy("brand", "name", "kind").agg(F.min("price").alias("price"))
    return each.groupBy("brand", "name").agg(F.array_sort(F.collect_list(F.struct(F.col("kind").alias("label"), "price"))).alias("v"))


_V = f"{_P}, v AS (SELECT brand, name, kind, min(price) AS price FROM p GROUP BY ALL)"


@R.add(f"""WITH {_V} SELECT brand, name, string_agg(kind || ' ' || price, ',' ORDER BY kind <> 'PROMO', price, kind) AS variants FROM v GROUP BY ALL HAVING count(*) >= 2""")
def variant_order(spark: SparkSession, d: str) -> DataFrame:
    found = _variants(spark, d).select("brand", "name", extract.variant_prices(F.col("v"), "PROMO").alias("v")).where("v is not null")
    return found.select("brand", "name", F.array_join(F.transform("v", lambda x: F.concat_ws(" ", x["label"], x["price"].cast("string"))), ",").alias("variants"))


@R.add(f"""WITH {_V} SELECT brand, name, arg_min(kind, (CASE WHEN kind = 'STANDARD' THEN 0 WHEN kind = 'SMALL' THEN 1 WHEN contains(kind, 'STANDARD') THEN 2 WHEN contains(kind, 'SMALL') THEN 3 ELSE 4 END, kind)) AS label FROM v GROUP BY ALL""")
def primary_variants(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d).select("brand", "name", extract.primary_variant(F.col("v"), ["STANDARD", "SMALL"])["label"].alias("label"))


@R.add(f"""WITH {_V}, s AS (SELECT brand, name, bool_or(kind = 'SMALL') AS has FROM v GROUP BY ALL) SELECT v.brand, v.name, string_agg(CASE WHEN kind = 'LARGE' THEN CASE WHEN has THEN 'セット（SMALLを含む）' ELSE '-' END ELSE kind END, ',' ORDER BY kind) AS labels FROM v JOIN s USING (brand, name) GROUP BY ALL""")
def relabelled_variants(spark: SparkSession, d: str) -> DataFrame:
    bare = F.transform("v", lambda x: F.struct(F.when(x["label"] != "LARGE", x["label"]).alias("label"), x["price"].alias("price")))
    found = _variants(spark, d).select("brand", "name", products.relabel_variants(bare, "SMALL").alias("v"))
    return found.select("brand", "name", F.array_join(F.transform("v", lambda x: F.coalesce(x["label"], F.lit("-"))), ",").alias("labels"))


@R.add(f"""WITH {_P}, h AS (SELECT brand, name, kind, min(price) AS eat, max(price) AS out FROM p GROUP BY ALL) SELECT brand, name, string_agg(kind || ' ' || eat, ',' ORDER BY kind) AS eat_in, coalesce(string_agg(kind || '（持ち帰り） ' || out, ',' ORDER BY kind) FILTER (out <> eat), '') AS takeout FROM h GROUP BY ALL""")
def takeout_variants(spark: SparkSession, d: str) -> DataFrame:
    each = _parts(spark, d).groupBy("brand", "name", "kind").agg(F.min("price").alias("eat"), F.max("price").alias("out"))
    list_of = lambda c: F.array_sort(F.collect_list(F.struct(F.col("kind").alias("label"), F.col(c).alias("price"))))
    both = each.groupBy("brand", "name").agg(list_of("eat").alias("e"), list_of("out").alias("o")).withColumn("v", products.with_takeout(F.col("e"), F.col("o")))
    told = lambda ok: F.array_join(F.transform(F.filter("v", ok), lambda x: F.concat_ws(" ", x["label"], x["price"].cast("string"))), ",")
    return both.select("brand", "name", told(lambda x: ~x["label"].endswith("（持ち帰り）")).alias("eat_in"), told(lambda x: x["label"].endswith("（持ち帰り）")).alias("takeout"))


@R.add("""SELECT record_id, strftime(first_seen_at, '%Y-%m-%d') AS start, status || 'まで' AS end_text FROM products WHERE first_seen_at IS NOT NULL AND name IS NOT NULL""")
def sales_periods(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").where("first_seen_at is not null and name is not null")
    written = _say(F.lit("お知らせ 【"), F.year("first_seen_at"), "年", F.month("first_seen_at"), "月", F.dayofmonth("first_seen_at"), "日〜", F.col("status"), "まで】 ")
    return p.select("record_id", extract.sales_period(written).alias("s")).select("record_id", F.col("s.start").cast("string").alias("start"), "s.end_text")


@R.add("""SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS "end" FROM orders""")
def compact_dates(spark: SparkSession, d: str) -> DataFrame:
    """Ends written as yyyymmdd, 99991231 for an open one."""
    written = F.when(F.col("o_orderstatus") == "O", F.lit("99991231")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), dates.compact_date(written).cast("string").alias("end"))


@R.add("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS size, (o_orderkey % 900)::int AS width FROM orders), f AS (SELECT k, arg_min(id, id) FILTER (size = '1-URGENT' AND width BETWEEN 300 AND 700) AS a, arg_min(id, id) FILTER (size = '2-HIGH' AND width BETWEEN 300 AND 700) AS b, arg_min(id, (width, 'u' || id)) FILTER (width >= 300) AS c, min(id) AS e FROM x GROUP BY 1)
    SELECT k, 'u' || coalesce(a, b, c, e) AS url FROM f""")
def thumbnails(spark: SparkSession, d: str) -> DataFrame:
    image = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("size"), (F.col("o_orderkey") % 900).cast("int").alias("width"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"))
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(image)).alias("i"))
    return by.select("k", extract.thumbnail(F.col("i"), ["1-URGENT", "2-HIGH"]).alias("url"))


@R.add("""WITH x AS (SELECT o_custkey AS k, o_orderpriority AS name, max(CASE o_orderstatus WHEN 'O' THEN 5 WHEN 'F' THEN 1 ELSE 0 END) AS level FROM orders GROUP BY ALL)
    SELECT k, coalesce(string_agg(name, ',' ORDER BY name) FILTER (level = 5), '') AS contains, coalesce(string_agg(name, ',' ORDER BY name) FILTER (level = 1), '') AS partial, coalesce(string_agg(name, ',' ORDER BY name) FILTER (level = 0), '') AS unknown FROM x GROUP BY 1""")
def allergen_levels(spark: SparkSession, d: str) -> DataFrame:
    level = F.max(F.when(F.col("o_orderstatus") == "O", 5).when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name")).agg(level.alias("level"))
    found = by.groupBy("k").agg(extract.levelled_allergens(F.collect_list(F.struct("name", "level"))).alias("a"))
    return found.select("k", *(F.array_join(f"a.{c}", ",").alias(c) for c in ("contains", "partial", "unknown")))


@R.add("""WITH x AS (SELECT o_custkey AS k, o_orderpriority AS name, max(CASE o_orderstatus WHEN 'O' THEN '1' WHEN 'F' THEN '5' WHEN 'P' THEN CASE WHEN o_totalprice > 300000 THEN '?' ELSE '0' END END) AS code FROM orders GROUP BY ALL)
    SELECT k, CASE WHEN bool_or(code = '?') THEN NULL ELSE coalesce(string_agg(name, ',' ORDER BY name DESC) FILTER (code = '1'), '') END AS contains, CASE WHEN bool_or(code = '?') THEN NULL ELSE coalesce(string_agg(name, ',' ORDER BY name DESC) FILTER (code = '5'), '') END AS partial FROM x GROUP BY 1""")
def allergen_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes in the order of a header; a table with an unknown code says nothing."""
    odd = F.when(F.col("o_totalprice") > 300000, "?").otherwise("0")
    code = F.max(F.when(F.col("o_orderstatus") == "O", "1").when(F.col("o_orderstatus") == "F", "5").otherwise(odd))
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name")).agg(code.alias("code"))
    header = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    found = by.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("name", "code"))).alias("m")).select("k", extract.strict_allergens(F.col("m"), header).alias("a"))
    return found.select("k", *(F.when(F.col("a").isNotNull(), F.array_join(f"a.{c}", ",")).alias(c) for c in ("contains", "partial")))


@R.add("""WITH x AS (SELECT o_custkey AS k, o_orderpriority AS name, bool_or(o_orderstatus = 'O') AS c, bool_or(o_orderstatus = 'F') AS p FROM orders GROUP BY ALL) SELECT k, coalesce(string_agg(name, ',' ORDER BY name) FILTER (c), '') AS contains, coalesce(string_agg(name, ',' ORDER BY name) FILTER (p AND NOT c), '') AS partial FROM x GROUP BY 1""")
def allergen_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of all sizes of an item: contained in any is contained."""
    mark = F.when(F.col("o_orderstatus") == "O", "●").when(F.col("o_orderstatus") == "F", "△").otherwise("-")
    found = products.allergens(table(spark, d, "orders").withColumns({"k": F.col("o_custkey"), "mark": mark}), keys=["k"], name="o_orderpriority", mark="mark")
    return found.select("k", *(F.array_join(c, ",").alias(c) for c in ("contains", "partial")))


@R.add("""SELECT record_id, trim(regexp_replace(name, '【(期間限定|店舗限定)】', '', 'g'), ' ') AS name, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(name, '【(期間限定|店舗限定)】', 1), CASE WHEN status = 'ended' THEN ['店舗限定'] ELSE [] END, CASE WHEN limited_kind IS NOT NULL THEN ['期間限定'] ELSE [] END))), ',') AS tags FROM products WHERE name IS NOT NULL""")
def stripped_tags(spark: SparkSession, d: str) -> DataFrame:
    written = _say(F.when(F.col("status") == "ended", "【店舗限定】").otherwise(""), F.col("name"), F.when(F.col("limited_kind").isNotNull(), "【期間限定】").otherwise(""))
    p = table(spark, d, "products").where("name is not null")
    return p.select("record_id", text.strip_tags(written, ["期間限定", "店舗限定"]).alias("s")).select("record_id", "s.name", F.array_join(F.array_sort("s.tags"), ",").alias("tags"))


@R.add("""SELECT record_id, price::double AS number, CASE WHEN status = 'ended' THEN '税込' END AS note FROM products WHERE price IS NOT NULL""")
def numbers_and_notes(spark: SparkSession, d: str) -> DataFrame:
    written = _say(F.translate(F.format_number("price", 0), "0123456789", "０１２３４５６７８９"), "円", F.when(F.col("status") == "ended", "（税込）").otherwise(""))
    return table(spark, d, "products").where("price is not null").select("record_id", text.number_and_note(written).alias("n")).select("record_id", "n.*")


@R.add("""SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS parts FROM orders GROUP BY 1""")
def listed_parts(spark: SparkSession, d: str) -> DataFrame:
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderpriority", F.col("o_orderkey").alias("o")))), lambda x: F.concat(x["o_orderpriority"], F.lit(" 、,　"))), "，")
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(cell.alias("c"))
    return by.select("k", F.array_join(F.array_sort(text.listed_parts(F.col("c"))), "|").alias("parts"))


@R.add("""SELECT record_id, CASE WHEN status = 'ended' THEN false WHEN is_regular THEN true WHEN limited_kind = '数量限定' THEN true END AS takeout FROM products""")
def takeout_flags(spark: SparkSession, d: str) -> DataFrame:
    tabs = F.array(F.when(F.col("is_regular"), "お持ち帰り").otherwise("店内"), F.lit(None).cast("string"))
    caption = F.when(F.col("status") == "ended", "店内のみ").when(F.col("limited_kind") == "数量限定", "持ち帰りできます")
    return table(spark, d, "products").select("record_id", extract.takeout(tabs, caption).alias("takeout"))


@R.add("SELECT o_custkey % 100 AS source, o_orderkey AS id, o_orderpriority AS title FROM orders")
def paged_articles(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a paged source that overlap: each article once."""
    return _paged(spark, d)[0].select("source", "id", "title")


@R.add("SELECT o_custkey % 100 AS source, max(o_orderdate::date - date '1992-01-01') // 60 + 2 AS page FROM orders GROUP BY 1")
def paged_missing(spark: SparkSession, d: str) -> DataFrame:
    """The pages that the total names and that are absent."""
    return _paged(spark, d)[1].select("source", F.col("page").cast("bigint").alias("page"))


def _paged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("source"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.floor(F.datediff("o_orderdate", F.to_date(F.lit("1992-01-01"))) / 60).cast("int").alias("p"))
    # an article also stands on the page behind its own; every page up to the last exists, be it empty
    both = o.withColumn("page", F.explode(F.array(F.col("p") + 1, F.col("p") + 2)))
    last = o.groupBy("source").agg((F.max("p") + 2).alias("total_pages"))
    body = both.groupBy("source", "page").agg(F.to_json(F.collect_list(F.struct("id", "title"))).alias("body"))
    every = last.select("source", "total_pages", F.explode(F.sequence(F.lit(1), F.col("total_pages") - 1)).alias("page"))
    pages = every.join(body, ["source", "page"], "left").withColumn("body", F.coalesce("body", F.lit("[]")))
    return extract.paged_articles(pages, "struct<id:bigint,title:string>", keep=["source"])


@R.add(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&yen;', '¥'), '&amp;', '&'), '[ \t\x{3000}\x{A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS plain
    FROM documents WHERE text IS NOT NULL""")
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.clean_text(text.strip_comments(F.col("text"))).alias("plain"))


@R.add("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM documents""")
def escaped_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.escape_html(F.col("text")).alias("safe"))


@R.add("SELECT l_orderkey AS k, l_linenumber AS n, format('{:g}', l_quantity) AS whole, format('{:g}', l_tax / 1000) AS small, format('{:g}', l_partkey * 1000000.0::double) AS large FROM lineitem")
def display_numbers(spark: SparkSession, d: str) -> DataFrame:
    forms = {"whole": F.col("l_quantity"), "small": F.col("l_tax") / 1000, "large": F.col("l_partkey") * 1_000_000.0}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), *(text.format_number(c).alias(name) for name, c in forms.items()))


@R.add("""SELECT record_id, coalesce(year(first_seen_at) || '年' || month(first_seen_at) || '月' || day(first_seen_at) || '日', '') || '〜' || coalesce(year(ended_observed_at) || '年' || month(ended_observed_at) || '月' || day(ended_observed_at) || '日' || CASE WHEN status = 'ended' THEN '(終了)' ELSE '' END, '') AS period FROM products""")
def period_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("record_id", dates.period_text(F.to_date("first_seen_at"), F.col("ended_observed_at"), F.col("status") == "ended").alias("period"))


@R.add("""WITH t AS (SELECT p_partkey AS k, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) SELECT k, (SELECT max(g) FROM generate_series(0, least(length(a), length(b))) t(g) WHERE a[:g] = b[:g])::int AS common FROM t WHERE b IS NOT NULL""")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", before.alias("b")).where("b is not null").select("k", text.common_prefix(F.col("p_name"), F.col("b")).alias("common"))


@R.add("""SELECT p_partkey AS k, p_name || CASE WHEN starts_with(p_name, 'small ') AND length(p_name) - 6 >= 4 THEN '|' || p_name[7:] ELSE '' END AS names FROM part WHERE length(p_name) >= 4""")
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("length(p_name) >= 4").select(F.col("p_partkey").alias("k"), F.array_join(text.name_variants(F.col("p_name"), ["small "]), "|").alias("names"))


@R.add("""SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS number, 'kcal' AS unit FROM lineitem""")
def split_units(spark: SparkSession, d: str) -> DataFrame:
    written = F.concat(F.format_number("l_extendedprice", 2), F.lit(" kcal"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.split_unit(written).alias("s")).select("k", "n", "s.*")


@R.add("""SELECT p_partkey AS k, p_size::bigint AS kcal, floor(p_retailprice)::bigint AS salt, p_partkey::bigint AS other FROM part""")
def label_maps(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(F.lit(0).cast("bigint"), F.col("p_size").cast("bigint"), F.col("p_retailprice").cast("bigint"), F.col("p_partkey").cast("bigint"))
    labels = F.array(F.lit("熱量"), F.lit("エネルギー"), F.lit("食塩"), F.lit("other"))
    m = text.label_map(labels, values, {"熱量": "kcal", "エネルギー": "kcal", "食塩": "salt"})
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), m.alias("m")).select("k", *(F.col("m")[c].alias(c) for c in ("kcal", "salt", "other")))


@R.add("""SELECT ref_id, CASE WHEN contains(canonical_name, '寿司') THEN 'sushi' WHEN category = 'ドリンク' THEN 'cup' WHEN category = 'トッピング' THEN NULL WHEN regexp_matches(canonical_name, 'うどん|そば|ラーメン') THEN 'noodles' WHEN regexp_matches(replace(canonical_name, '店長の', ''), '長') THEN 'long' ELSE 'dish' END AS icon FROM menu_reference""")
def icon_chain(spark: SparkSession, d: str) -> DataFrame:
    rules = [("うどん|そば|ラーメン", "noodles"), ("長", "long")]
    icon = text.classify_name(F.col("canonical_name"), rules, drop="店長の", overrides={"寿司": "sushi"}, table={"ドリンク": "cup", "トッピング": ""}, group=F.col("category"), fallback="dish")
    return table(spark, d, "menu_reference").select("ref_id", icon.alias("icon"))


@R.add("""SELECT record_id, regexp_extract(official_url, '^[A-Za-z]+://[^/]*(/[^?#]*)', 1) AS path FROM products WHERE regexp_matches(official_url, '^[A-Za-z]+://[^/]+/[^?#]')""")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with detours come out as they are without them."""
    path = F.regexp_extract("official_url", r"^[A-Za-z]+://[^/]*(/[^?#]*)", 1)
    p = table(spark, d, "products").where(F.col("official_url").rlike(r"^[A-Za-z]+://[^/]+/[^?#]"))
    return p.select("record_id", text.resolve_path(F.concat(F.lit("/a/./b/../.."), path)).alias("path"))


@R.add("""SELECT chain, kind, count(*) AS n FROM (SELECT chain, CASE WHEN http_status IN (401, 403, 429) THEN 'blocked' WHEN http_status = 404 THEN 'not_found' WHEN http_status BETWEEN 200 AND 299 AND ok THEN 'ok' WHEN http_status BETWEEN 200 AND 299 AND ok IS NOT NULL THEN 'blocked' ELSE 'error' END AS kind FROM snapshot_runs) GROUP BY ALL""")
def page_states(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("ok"), "<html>menu</html>").when(~F.col("ok"), "<title>Just a moment...</title>")
    ok = F.when(F.col("http_status").between(200, 299), body).otherwise("x")
    runs = table(spark, d, "snapshot_runs")
    return runs.groupBy("chain", landed.page_state(F.col("http_status"), ok).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH x AS (SELECT l_suppkey AS chain, 'u' || l_partkey AS url, min(l_orderkey) AS ord FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY ord, url) AS r FROM x) SELECT chain, url, ord, ((r - 1) * 3)::int AS wait_s FROM r WHERE r <= 10""")
def fetch_queue(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chain"), F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), F.col("l_orderkey").alias("ord"))
    return landed.fetch_queue(wanted, budget=10).withColumn("wait_s", F.col("wait_s").cast("int"))


@R.add("SELECT p_partkey AS k, NOT (starts_with(p_name, 'small') AND p_name <> 'small ring') AS allowed FROM part")
def robots_paths(spark: SparkSession, d: str) -> DataFrame:
    rules = "User-agent: *\nDisallow: /small\nAllow: /small ring$\nAllow: /small ring\n"
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), landed.robots_allow(F.lit(rules), F.concat(F.lit("/"), "p_name")).alias("allowed"))


@R.add("""WITH m AS (SELECT p_partkey AS row, (p_size % 4) * 20 + 3.0 AS x FROM part) SELECT row, CASE WHEN x = 3 THEN '●' END AS a, CASE WHEN x = 23 THEN '●' END AS b, CASE WHEN x = 43 THEN '●' END AS c FROM m""")
def mark_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Marks of table rows under the header nearest to them; a mark too far from every header gives a row without marks."""
    marks = table(spark, d, "part").select(F.col("p_partkey").alias("row"), ((F.col("p_size") % 4) * 20 + 3.0).alias("x"), F.lit("●").alias("mark"))
    columns = spark.createDataFrame([("a", 0.0), ("b", 20.0), ("c", 40.0)], "name string, x double")
    found = geometry.mark_matrix(marks, columns, row=["row"], x="x", names=["a", "b", "c"])
    return marks.select("row").join(found, "row", "left")


@R.add("""WITH x AS (SELECT p_brand AS brand, p_name AS name, p_type AS size, p_retailprice AS kcal FROM part), y AS (SELECT brand, name, size, min(kcal) AS kcal FROM x GROUP BY ALL) SELECT brand, name, arg_min(kcal, (size <> 'STANDARD', size)) AS kcal, CASE WHEN count(*) >= 2 THEN count(*) ELSE 0 END AS variants FROM y GROUP BY ALL""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("size")).agg(F.min("p_retailprice").alias("kcal"))
    found = products.representative(rows, keys=["brand", "name"], size="size", values=["kcal"], first="STANDARD")
    return found.select("brand", "name", "kcal", F.greatest(F.size("variants"), F.lit(0)).cast("bigint").alias("variants"))


@R.add("""WITH g AS (SELECT *, abs(p_size * 4 + 1 * 9 + 25 * 4 - p_retailprice / 4) <= greatest(p_retailprice / 4 * 0.15, 6.0) AS ok FROM part) SELECT p_brand AS brand, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS wrong FROM g GROUP BY 1""")
def energy_gate(spark: SparkSession, d: str) -> DataFrame:
    ok = gates.energy_ok(F.col("p_size"), F.lit(1), F.lit(25), F.col("p_retailprice") / 4)
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("wrong"))


@R.add("""SELECT DISTINCT chain, category FROM product_snapshots WHERE category IS NOT NULL""")
def category_links(spark: SparkSession, d: str) -> DataFrame:
    """Category links of navigation pages, each once in the order of their first place."""
    rows = table(spark, d, "product_snapshots").where("category is not null").select("chain", "category").distinct()
    page = _page(rows, ["chain"], _say('<a class="nav" href="/', F.col("category"), '/">x</a><a class="nav" href="/', F.col("category"), '/">again</a>'), "category")
    links = extract.Field("links", r'class="nav" href="/([^"/]+)/"', "list")
    return page.select("chain", F.explode(F.array_distinct(links.column(F.col("body")))).alias("category"))




@R.add("""SELECT p_partkey AS k, round(p_retailprice * (100.0 / (p_size + 50)), 6) AS x FROM part""")
def scaled_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of pages of different heights, on one scale."""
    p = table(spark, d, "part")
    pages = p.select(F.col("p_size").alias("page")).distinct().withColumn("h", F.col("page") + 50)
    points = p.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("page"), F.col("p_retailprice").alias("x"))
    return geometry.scaled(points, pages, page=["page"], columns=["x"], height="h", standard=100.0).select("k", F.round("x", 6).alias("x"))


@R.add("""WITH g AS (SELECT p_partkey AS k, p_retailprice AS x, unnest(string_split(p_name, '')) AS mark, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part) SELECT k, mark, round(x + i * 2.5, 6) AS x FROM g WHERE mark <> ' '""")
def unglued_marks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("mark"), F.col("p_retailprice").alias("x"))
    return geometry.unglued(p, mark="mark", x="x", width=2.5).withColumn("x", F.round("x", 6))


@R.add("""WITH b AS (SELECT p_brand AS brand, floor(p_retailprice / 20)::int AS band, p_retailprice AS y, p_partkey AS x, p_type AS t FROM part) SELECT brand, band, string_agg(t, '' ORDER BY y DESC, x) AS name, count(DISTINCT y) AS lines FROM b WHERE band < 60 GROUP BY ALL""")
def band_names(spark: SparkSession, d: str) -> DataFrame:
    """Texts of table cells that span several rows, joined in reading order."""
    glyphs = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("y"), F.col("p_partkey").alias("x"), F.col("p_type").alias("t"))
    bands = glyphs.select("brand").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumns({"low": F.col("band") * 20.0, "high": (F.col("band") + 1) * 20.0})
    return geometry.band_names(glyphs, bands, keys=["brand"], y="y", x="x", text="t", low="low", high="high", width=20.0)


@R.add("""WITH h AS (SELECT p_brand AS brand, p_partkey AS page, p_size % 5 AS col, p_type AS t FROM part), v AS (SELECT brand, col, t, count(*) AS n FROM h GROUP BY ALL), u AS (SELECT brand, col, arg_min(t, (-n, t)) AS usual FROM v GROUP BY ALL) SELECT h.brand, page, col, t, usual FROM h JOIN u USING (brand, col) WHERE t <> usual""")
def header_problems(spark: SparkSession, d: str) -> DataFrame:
    """Column headers that differ from what most pages say."""
    h = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("page"), (F.col("p_size") % 5).alias("col"), F.col("p_type").alias("t"))
    return geometry.header_problems(h, keys=["brand"], page="page", column="col", text="t")


@R.add("""WITH l AS (SELECT p_brand AS brand, p_retailprice * 100 + p_partkey / 1000000.0 AS y, p_type AS t FROM part), m AS (SELECT *, t = 'PROMO' AS s, lag(y) OVER (PARTITION BY brand ORDER BY y DESC) - y AS gap FROM l),
    b AS (SELECT *, sum((s OR coalesce(gap > 200, true))::int) OVER (PARTITION BY brand ORDER BY y DESC) AS b FROM m) SELECT brand, round(max(y), 4) AS y, string_agg(t, '' ORDER BY y DESC) AS t FROM b GROUP BY brand, b HAVING bool_or(s)""")
def legend_lines(spark: SparkSession, d: str) -> DataFrame:
    """Legend lines with their continuation lines."""
    lines = table(spark, d, "part").select(F.col("p_brand").alias("brand"), (F.col("p_retailprice") * 100 + F.col("p_partkey") / 1_000_000.0).alias("y"), F.col("p_type").alias("t"))
    return geometry.legend_lines(lines, keys=["brand"], y="y", text="t", start="^PROMO$", gap=200.0).select("brand", F.round("y", 4).alias("y"), "t")
