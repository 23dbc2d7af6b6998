"""Records out of landed pages and API answers, declared as fields of cards.

A listing page is a row of cards between markers; a card has fields that regular
expressions find. :func:`cards` turns pages into one row per card with its place, :func:`fields`
turns detail pages into one row each, :func:`labelled` turns tables of label and value into maps, and the JSON forms go
through schemas. All are projections with one generator: nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menuflow.functions.text import clean_text, strip_comments, to_number


@dataclass(frozen=True)
class Field:
    """``pattern`` finds the value (its first group). ``kind``: text, raw, int, number, flag (is it found), list (all finds)."""

    name: str
    pattern: str
    kind: str = "text"

    def column(self, html: Column) -> Column:
        if self.kind == "flag":
            return html.rlike(self.pattern).alias(self.name)
        if self.kind == "list":
            return F.transform(F.regexp_extract_all(html, F.lit(self.pattern), F.lit(1)), clean_text).alias(self.name)
        found = F.nullif(F.regexp_extract(html, self.pattern, 1), F.lit(""))
        if self.kind == "int":
            return to_number(found).cast("int").alias(self.name)
        if self.kind == "number":
            return to_number(found).alias(self.name)
        return (found if self.kind == "raw" else F.nullif(clean_text(found), F.lit(""))).alias(self.name)


@dataclass(frozen=True)
class Listing:
    """A kind of listing page: ``marker`` begins a card, ``section`` (optional) a section with the field ``section_title``.
    Cards without the first field are notices, no items."""

    marker: str
    fields: Sequence[Field]
    section: str | None = None
    section_title: Field | None = None


def _rest(parts: Column) -> Column:
    """An array without its first element."""
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))


def cards(pages: DataFrame, kind: Listing, *, keep: Sequence[str] = (), body: str = "body") -> DataFrame:
    """(keep, section, card_ord, fields): the cards of each page in their order; ``card_ord`` counts over the whole page.

    Comments are dropped first. Pages without cards, null and empty bodies have no rows.
    """
    html = strip_comments(F.col(body))
    if kind.section:
        parts = F.posexplode(_rest(F.split(html, kind.section))).alias("_s", "_part")
        pages = pages.select(*keep, parts).withColumn("section", kind.section_title.column(F.col("_part")))
    else:
        pages = pages.select(*keep, F.lit(0).alias("_s"), html.alias("_part"), F.lit(None).cast("string").alias("section"))
    split = F.posexplode(_rest(F.split("_part", kind.marker))).alias("_c", "_card")
    out = pages.select(*keep, "section", "_s", split)
    found = out.select(*keep, "section", (F.col("_s").cast("bigint") * 1_000_000 + F.col("_c")).alias("card_ord"), *(f.column(F.col("_card")) for f in kind.fields))
    return found.where(F.col(kind.fields[0].name).isNotNull())


def fields(pages: DataFrame, wanted: Sequence[Field], *, keep: Sequence[str] = (), body: str = "body") -> DataFrame:
    """(keep, fields): one row per detail page; pages without the first field have none."""
    html = strip_comments(F.col(body))
    return pages.select(*keep, *(f.column(html) for f in wanted)).where(F.col(wanted[0].name).isNotNull())


def labelled(html: Column, row: str) -> Column:
    """A map of label to value from the rows that ``row`` finds (two groups); of repeated labels the last value stands."""
    labels = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(1)), clean_text)
    values = F.transform(F.regexp_extract_all(html, F.lit(row), F.lit(2)), clean_text)
    pairs = F.arrays_zip(labels.alias("k"), values.alias("v"))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(F.map_filter(acc, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def json_island(body: Column, schema: str, mark: str = "__NEXT_DATA__") -> Column:
    """The value of a page's JSON island, parsed by ``schema``; null where there is none or it can't be read."""
    text = F.nullif(F.regexp_extract(body, rf'(?s)<script id="{mark}"[^>]*>(.*?)</script>', 1), F.lit(""))
    return F.from_json(text, schema)


def envelope(answers: DataFrame, schema: str, *, keep: Sequence[str] = (), body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(good, bad): answers whose ``header.result`` is true and that have a body of ``schema``, as ``data``; and the rest with a reason."""
    parsed = answers.withColumn("_j", F.from_json(body, f"header struct<result:boolean>, body {schema}"))
    good = F.coalesce(F.col("_j.header.result"), F.lit(False)) & F.col("_j.body").isNotNull()
    return parsed.where(good).select(*keep, F.col("_j.body").alias("data")), parsed.where(~good).select(*keep, F.lit("envelope").alias("reason"))


def first_by_priority(rows: DataFrame, *, keys: Sequence[str], low: str, section: str = "section", order: str = "card_ord") -> DataFrame:
    """One row per key: its first row in a section other than ``low``, else its first at all; ``in_low``: was it in ``low``."""
    rank = F.struct((F.col(section) == low).cast("int"), F.col(order))
    columns = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), rank).alias("_r"), F.bool_or(F.col(section) == low).alias("in_low"))
    return best.select(*keys, "_r.*", "in_low")


def sales_period(text: Column) -> Column:
    """(start, end text) of 【Y年M月D日〜...】."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"【([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日[〜～~]([^】]*)】", i), F.lit(""))
    start = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")
    return F.struct(F.when(part(1).isNotNull(), start).alias("start"), part(4).alias("end_text"))


def news_rows(pages: DataFrame, *, item: str, date: str, title: str, link: str, keep: Sequence[str] = (), body: str = "body") -> DataFrame:
    """(keep, ord, date, title, link): dated news of listing pages, each (date, title, link) once, the first place kept; items
    without a readable date are dropped."""
    rows = pages.select(*keep, F.posexplode(_rest(F.split(strip_comments(F.col(body)), item))).alias("ord", "_i"))
    day = F.regexp_replace(F.regexp_extract("_i", date, 1), r"[./年月]", "-").try_cast("date")
    found = rows.select(*keep, "ord", day.alias("date"), clean_text(F.regexp_extract("_i", title, 1)).alias("title"), F.nullif(F.regexp_extract("_i", link, 1), F.lit("")).alias("link"))
    return found.where("date is not null").groupBy(*keep, "date", "title", "link").agg(F.min("ord").alias("ord"))


def variant_prices(variants: Column, first: str) -> Column:
    """Variants with the one labelled ``first`` in front, the others by price; null with fewer than two."""
    ordered = F.array_sort(F.transform(variants, lambda v: F.struct((v["label"] != first).cast("int").alias("o"), v["price"].alias("price"), v["label"].alias("label"))))
    return F.when(F.size(variants) >= 2, F.transform(ordered, lambda v: F.struct(v["label"].alias("label"), v["price"].alias("price"))))


def primary_variant(variants: Column, labels: Sequence[str]) -> Column:
    """The variant that stands for an item: the first labelled as one of ``labels`` (in their order; an empty one means
    unlabelled), then one whose label contains it, then the first."""
    pick = lambda fits: F.get(F.filter(variants, fits), F.lit(0))
    labelled_as = lambda x: lambda v: F.coalesce(v["label"], F.lit("")) == F.lit(x)
    containing = lambda x: lambda v: F.contains(v["label"], F.lit(x))
    exact = [pick(labelled_as(x)) for x in labels]
    within = [pick(containing(x)) for x in labels if x]
    return F.coalesce(*exact, *within, F.get(variants, F.lit(0)))


def thumbnail(images: Column, sizes: Sequence[str], low: int = 300, high: int = 700) -> Column:
    """The address of an article's picture: the first of the preferred ``sizes`` with a width in between, else the narrowest
    of at least ``low``, else the first."""
    of_size = lambda s: lambda i: (i["size"] == F.lit(s)) & i["width"].between(low, high)
    fit = [F.get(F.filter(images, of_size(s)), F.lit(0))["url"] for s in sizes]
    wide = F.array_min(F.transform(F.filter(images, lambda i: i["width"] >= low), lambda i: F.struct(i["width"], i["url"])))["url"]
    return F.coalesce(*fit, wide, F.get(images, F.lit(0))["url"])


# The marks of the listing pages that are known.
CARD_GRID = Listing(
    r"<div class='product-list-card ",
    (
        Field("product_id", r"data-product-code='([^']+)'", "raw"),
        Field("name", r"(?s)product-list-card-name[^>]*>(.*?)</strong>"),
        Field("price", r"product-list-card-price-number[^>]*>([0-9,]+)", "int"),
        Field("started", r"data-time-limited-offer-started-at='([0-9-]{10})", "raw"),
        Field("limited", r"data-time-limited-offer-started-at='|data-time-limited-offer='true'[^>]*class='(?![^']*\bhidden\b)[^']*'", "flag"),
        Field("detail_url", r" href='(/[^']+)'", "raw"),
    ),
)
SECTION_LIST = Listing(
    r'<li class="menu-list__item">',
    (
        Field("product_id", r"/menu/([0-9A-Za-z_-]+)/", "raw"),
        Field("name", r'(?s)class="menu-list__name"[^>]*>(.*?)</h3>'),
        Field("price", r'class="menu-price__tax">[^0-9]*([0-9,]+)', "int"),
        Field("price_ex_tax", r'class="menu-price__number[^"]*">([0-9,]+)', "int"),
        Field("badges", r'class="menu-icon__txt">([^<]*)<', "list"),
    ),
    section=r'<section class="menu-list__section',
    section_title=Field("section", r'(?s)class="menu-list__ttl"[^>]*>(.*?)</h2>'),
)
TAB_LIST = Listing(
    r'<li class="c-menuListItem">',
    (
        Field("product_id", r"[?&]id=([0-9A-Za-z_-]+)", "raw"),
        Field("name", r'(?s)class="c-menuListTitle"[^>]*>(.*?)</p>'),
        Field("price", r'class="c-menuListPriceNum">([0-9,]+)', "int"),
        Field("notes", r'class="menuListTagItem">([^<]*)<', "list"),
    ),
    section=r'<section class="c-menuListWrap',
    section_title=Field("section", r'(?s)<h2[^>]*>(.*?)</h2>'),
)
PICTURE_LIST = Listing(
    r"<li>\s*<a href=\"(?=[^\"]*/detail/)",
    (Field("product_id", r"/detail/([0-9A-Za-z_-]+)\.html", "raw"), Field("name", r"(?s)<dd><span>(.*?)</span>"), Field("price", r'<span>([0-9,]+)</span>\s*<span class="yen">', "int")),
)
DEFINITION_ROWS = r'(?s)<dt class="menuDataTableTitle">(.*?)</dt>\s*<dd class="menuDataTableText">(.*?)</dd>'
TABLE_ROWS = r"(?s)<tr>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"
MENU_BODY = "struct<allMenuList:array<struct<menuCategoryNm:string,menuInfo:array<struct<menuCd:string,menuNm:string,dineInPrc:string,prcRangeYn:string>>>>>"


def api_menu(good: DataFrame, *, keep: Sequence[str] = (), drop: str = "セット", low: str = "おすすめ") -> DataFrame:
    """(keep, product_id, name, price, section, card_ord, in_low): the flat menu of API answers; sets are left out, the first category that isn't ``low`` counts."""
    cats = good.select(*keep, F.posexplode("data.allMenuList").alias("_c", "_cat"))
    items = cats.select(*keep, "_c", F.col("_cat.menuCategoryNm").alias("section"), F.posexplode("_cat.menuInfo").alias("_i", "_m"))
    flat = items.select(*keep, F.col("_m.menuCd").alias("product_id"), F.col("_m.menuNm").alias("name"), to_number(F.col("_m.dineInPrc")).cast("int").alias("price"), "section", (F.col("_c").cast("bigint") * 1_000_000 + F.col("_i")).alias("card_ord"))
    return first_by_priority(flat.where(~F.contains("name", F.lit(drop))), keys=[*keep, "product_id"], low=low)


def strict_allergens(codes: Column, names: Sequence[str]) -> Column:
    """(contains, partial) from a map of allergen to code, in the order of ``names``: 1 says contained, 5 in part; null as a whole if any other
    code stands there (a table that isn't understood says nothing)."""
    sound = F.forall(F.map_values(codes), lambda v: v.isNull() | v.isin("", "0", "1", "5"))
    of = lambda code: F.filter(F.array(*(F.when(F.try_element_at(codes, F.lit(n)) == code, F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return F.when(sound, F.struct(of("1").alias("contains"), of("5").alias("partial")))


def levelled_allergens(levels: Column) -> Column:
    """(contains, partial, unknown) from an array of (name, level): level 5 is contained, 1 in part, any other unknown; sorted."""
    of = lambda ok: F.array_sort(F.array_distinct(F.transform(F.filter(levels, ok), lambda x: x["name"])))
    return F.struct(of(lambda x: x["level"] == 5).alias("contains"), of(lambda x: x["level"] == 1).alias("partial"), of(lambda x: ~F.coalesce(x["level"].isin(1, 5), F.lit(False))).alias("unknown"))


def takeout(tabs: Column, caption: Column, yes: str = "持ち帰り", no: str = "店内のみ") -> Column:
    """Whether an item can be taken out: true if a tab or the caption says so, false if one says the opposite, else null."""
    said = lambda word: F.coalesce(F.exists(tabs, lambda t: F.contains(t, F.lit(word))), F.lit(False)) | F.coalesce(F.contains(caption, F.lit(word)), F.lit(False))
    return F.when(said(no), False).when(said(yes), True)


def paged_articles(pages: DataFrame, schema: str, *, keep: Sequence[str] = (), page: str = "page", total: str = "total_pages", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(articles, missing): the articles of landed answers of a paged source, each id once, the copy of the first page kept; and the
    (keep, page) that the answers' own total says but that are absent or can't be read as a list of ``schema`` (which has an ``id``)."""
    parsed = pages.withColumn("_a", F.from_json(body, f"array<{schema}>"))
    flat = parsed.select(*keep, F.col(page).alias("_p"), F.posexplode("_a").alias("_o", "_x")).where(F.col("_x.id").isNotNull())
    articles = flat.groupBy(*keep, F.col("_x.id").alias("id")).agg(F.min_by("_x", F.struct("_p", "_o")).alias("_b")).select(*keep, "_b.*")
    wanted = pages.groupBy(*keep).agg(F.max(total).alias("_n")).where("_n > 0").select(*keep, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias(page))
    return articles, wanted.join(parsed.where("_a is not null").select(*keep, page).distinct(), [*keep, page], "left_anti")
