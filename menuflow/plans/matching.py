"""Queries that match items with announcements and reviews, over titles that are put together from table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.functions import text
from menuflow.operators import lifecycle, match, merge
from menuflow.plans.registry import Registry
from menuflow.sources.tables import table

R = Registry()
DAY_ONE = "1995-01-01"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items of their brand, each with a day on which it was first seen."""
    ref = F.date_add(F.to_date(F.lit(DAY_ONE)), (F.col("p_size") * 8).cast("int"))
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name"), ref.alias("ref"))


def _news(spark: SparkSession, d: str) -> DataFrame:
    """An announcement for each part: quoted or not, with a day in the headline or not, of a launch or an end, by the part's type."""
    p = table(spark, d, "part")
    date = F.date_add(F.to_date(F.lit(DAY_ONE)), (F.col("p_partkey") % 400).cast("int"))
    quoted = F.concat(F.lit("「"), F.initcap("p_name"), F.lit("」"))
    day = F.concat(F.month(date).cast("string"), F.lit("月"), F.dayofmonth(date).cast("string"), F.lit("日"))
    kind = F.col("p_type")
    title = (
        F.when(kind == "ECONOMY", F.concat(day, F.lit(" "), quoted, F.lit("を発売")))
        .when(kind == "SMALL", F.concat(F.lit("本日 "), F.col("p_name"), F.lit(" 新登場")))
        .when(kind == "STANDARD", F.concat(day, F.lit(" "), quoted, F.lit("は販売終了")))
        .when(kind == "PROMO", F.concat(quoted, F.lit("新登場")))
        .otherwise(F.concat(day, F.lit("「a・"), F.col("p_name"), F.lit("」など発売")))
    )
    return p.select(F.col("p_brand").alias("brand"), date.alias("date"), title.alias("title"), F.col("p_partkey").alias("news_id"))


_BASE = f"""i AS (SELECT p_brand AS brand, p_partkey AS partkey, p_name AS name, replace(lower(p_name), ' ', '') AS k, date '{DAY_ONE}' + p_size * 8 AS ref FROM part),
    m AS (SELECT *, date '{DAY_ONE}' + (p_partkey % 400)::int AS date FROM part),
    dd AS (SELECT *, month(date) || '月' || day(date) || '日' AS dd, '「' || upper(p_name[1]) || p_name[2:] || '」' AS q0 FROM m),
    n AS (SELECT p_brand AS brand, date, p_partkey AS news_id, p_type AS kind, replace(lower(p_name), ' ', '') AS k,
          CASE p_type WHEN 'ECONOMY' THEN dd || ' ' || '「' || init || '」を発売' WHEN 'SMALL' THEN '本日 ' || p_name || ' 新登場' WHEN 'STANDARD' THEN dd || ' 「' || init || '」は販売終了' WHEN 'PROMO' THEN '「' || init || '」新登場' ELSE dd || '「a・' || p_name || '」など発売' END AS title
          FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS init FROM dd))"""


def _launched(spark: SparkSession, d: str, **how: object) -> DataFrame:
    found = match.launches(
        _items(spark, d), _news(spark, d), scope=["brand"], key="partkey", name=F.col("name"), reference="ref", title="title", date="date", words="発売|登場", no_words="終了", **how
    )
    return found.select("brand", "partkey", *(F.col(c).cast("string").alias(c) for c in ("date", "title", "launch")))


_TOLD = "SELECT i.brand, partkey, max(struct_pack(d := date, t := title)) AS b FROM i JOIN n ON n.brand = i.brand AND (n.k = i.k OR (kind = 'SMALL' AND contains(n.k, i.k))) AND date BETWEEN ref - {before} AND ref + {after} WHERE {kinds} GROUP BY ALL"
_LAUNCH = "WITH " + _BASE + ", b AS (" + _TOLD + ") SELECT brand, partkey, b.d::varchar AS date, b.t AS title, {launch} AS launch FROM b"


@R.add(_LAUNCH.format(before=120, after=14, kinds="kind IN ('ECONOMY', 'SMALL')", launch="b.d::varchar"))
def launches_dated(spark: SparkSession, d: str) -> DataFrame:
    """The latest announcement that tells a day, by quotes or, without quotes, by the name in the title."""
    return _launched(spark, d)


@R.add(_LAUNCH.format(before=90, after=14, kinds="kind IN ('ECONOMY', 'SMALL', 'PROMO')", launch="CASE WHEN NOT starts_with(b.t, '「') THEN b.d::varchar END"))
def launches_any_day(spark: SparkSession, d: str) -> DataFrame:
    """As above, where a title without a day counts too and leaves the launch open."""
    return _launched(spark, d, before=90, need_day=False)


@R.add(_LAUNCH.format(before=120, after=14, kinds="kind NOT IN ('STANDARD', 'PROMO')", launch="b.d::varchar"))
def launches_split_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes that list several names are split."""
    return _launched(spark, d, split="・", drop_brackets=True)


@R.add(_LAUNCH.format(before=120, after=14, kinds="kind IN ('ECONOMY')", launch="b.d::varchar"))
def launches_strict(spark: SparkSession, d: str) -> DataFrame:
    """Only quotes right before a launch word."""
    return _launched(spark, d, strict=2)


@R.add("WITH " + _BASE + """, f AS (SELECT DISTINCT i.brand, partkey FROM i JOIN n ON n.brand = i.brand AND n.k = i.k AND date BETWEEN ref - 120 AND ref + 14 WHERE kind = 'ECONOMY'),
    o AS (SELECT * FROM i ANTI JOIN f USING (brand, partkey))
    SELECT o.brand, partkey, max(date)::varchar AS date FROM o JOIN n ON n.brand = o.brand AND date BETWEEN ref - 14 AND ref + 7 AND contains(replace(lower(title), ' ', ''), o.k) WHERE regexp_matches(title, '発売|登場') GROUP BY ALL""")
def launches_by_body(spark: SparkSession, d: str) -> DataFrame:
    """Items without an announcement are looked up in the bodies of articles, in a narrower window."""
    items, news = _items(spark, d), _news(spark, d)
    found = match.launches(items, news, scope=["brand"], key="partkey", name=F.col("name"), reference="ref", title="title", date="date", words="発売|登場", no_words="終了", strict=2)
    bodies = match.body_launches(items, news, found, scope=["brand"], key="partkey", name=F.col("name"), reference="ref", body="title", date="date", words="発売|登場")
    return bodies.select("brand", "partkey", F.col("date").cast("string").alias("date"))


@R.add("WITH " + _BASE + """, b AS (SELECT i.brand, partkey, max(struct_pack(d := date, t := title)) AS b FROM i JOIN n ON n.brand = i.brand AND n.k = i.k AND date BETWEEN ref AND ref + 60 WHERE kind = 'STANDARD' GROUP BY ALL)
    SELECT brand, partkey, b.d::varchar AS date, b.t AS title FROM b""")
def end_notices(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("until", F.date_add("ref", 60))
    found = match.end_notices(items, _news(spark, d), scope=["brand"], key="partkey", name=F.col("name"), since="ref", until="until", title="title", date="date")
    return found.select("brand", "partkey", F.col("date").cast("string").alias("date"), "title")


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """A review of each part: the name alone, with more around it, or shortened to its last word."""
    kind = F.col("p_type")
    name = F.when(kind == "ECONOMY", F.upper("p_name")).when(kind == "SMALL", F.concat(F.lit("The "), F.col("p_name"), F.lit(" (large)"))).when(kind == "PROMO", F.substring_index("p_name", " ", -1)).otherwise(F.concat(F.lit("x-"), F.reverse("p_name")))
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("review"), name.alias("title"), F.date_add(F.to_date(F.lit(DAY_ONE)), (F.col("p_partkey") % 400).cast("int")).alias("date"))


_REVIEWS = f"""i AS (SELECT p_brand AS brand, p_partkey AS partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, date '{DAY_ONE}' + p_size * 8 AS ref FROM part),
    r AS (SELECT p_brand AS brand, p_partkey AS review, date '{DAY_ONE}' + (p_partkey % 400)::int AS date, regexp_replace(lower(CASE p_type WHEN 'ECONOMY' THEN p_name WHEN 'SMALL' THEN 'The ' || p_name || ' (large)' WHEN 'PROMO' THEN string_split(p_name, ' ')[-1] ELSE 'x-' || reverse(p_name) END), '[^a-z0-9]', '', 'g') AS b FROM part),
    l AS (SELECT DISTINCT i.brand, partkey, review FROM i JOIN r ON i.brand = r.brand AND (a = b OR (length(a) >= 6 AND contains(b, a)) OR (length(b) >= 6 AND contains(a, b))) WHERE ref - date <= 14)"""


def _linked_by(spark: SparkSession, d: str) -> dict[str, object]:
    return {"items": _items(spark, d), "reviews": _reviews(spark, d), "scope": ["brand"], "key": "partkey", "name": F.col("name"), "launch": "ref", "review": "review", "review_name": F.col("title"), "date": "date"}


def _links(spark: SparkSession, d: str) -> DataFrame:
    return match.review_links(**_linked_by(spark, d))


@R.add(f"WITH {_REVIEWS} SELECT brand, partkey, count(*) AS reviews, min(review) AS first, max(review) AS last FROM l GROUP BY ALL")
def review_links(spark: SparkSession, d: str) -> DataFrame:
    """How many reviews each item has: equal names, or the shorter within the longer."""
    return match.review_counts(**_linked_by(spark, d))


@R.add(f"""WITH {_REVIEWS}, o AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.brand = r.brand AND l.review = r.review)),
    p AS (SELECT DISTINCT o.brand, review, partkey, (SELECT max(g) FROM generate_series(0, least(length(a), length(b))) t(g) WHERE a[:g] = b[:g]) AS common FROM o JOIN i ON i.brand = o.brand AND length(a) >= 4 AND length(b) >= 4 AND a[:4] = b[:4]),
    q AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY common DESC, review, partkey) AS n FROM p) SELECT brand, review, partkey, common::int AS common FROM q WHERE n <= 20""")
def review_near_misses(spark: SparkSession, d: str) -> DataFrame:
    """For reviews without a link, the items whose names begin alike."""
    return match.near_misses(_items(spark, d), _reviews(spark, d), _links(spark, d), scope=["brand"], key="partkey", name=F.col("name"), review="review", review_name=F.col("title")).select("brand", "review", "partkey", "common")


@R.add(f"""WITH {_REVIEWS}, w AS (SELECT * FROM (VALUES ('ring', 1), ('widget', 2), ('bolt', 3), ('gear', 4)) t(word, o)), a AS (SELECT brand AS own, review, date, word FROM r JOIN w ON contains(b, word)),
    x AS (SELECT c.brand, w.word, a.review, row_number() OVER (PARTITION BY c.brand, w.word ORDER BY (a.own = c.brand) DESC, a.date DESC, a.review) AS rank FROM (SELECT DISTINCT brand FROM i) c CROSS JOIN w JOIN a ON a.word = w.word AND NOT EXISTS (SELECT 1 FROM l WHERE l.brand = c.brand AND l.review = a.review))
    SELECT brand, word, review, rank FROM x WHERE rank <= 4""")
def keyword_articles(spark: SparkSession, d: str) -> DataFrame:
    """For each word and brand the four articles to show: not linked to the brand's items, its own first, then the latest."""
    words = F.filter(F.array(*(F.when(F.contains(text.review_key(F.col("title")), F.lit(w)), F.lit(w)) for w in ("ring", "widget", "bolt", "gear"))), lambda w: w.isNotNull())
    articles = _reviews(spark, d).select(F.col("brand").alias("own"), "review", "date", F.explode(words).alias("word"))
    linked = _links(spark, d).select("brand", "review").distinct()
    latest = [F.desc("date"), "review"]
    own = articles.withColumn("brand", F.col("own")).join(linked, ["brand", "review"], "left_anti")
    own = merge.top_by(own, scope=["brand", "word"], order=latest, limit=4).select("brand", "word", "review", "date", F.lit(0).alias("far"))
    # others: of each word only the latest of every brand can be among the first four of another one
    best = merge.top_by(articles, scope=["word", "own"], order=latest, limit=4).drop("rank")
    brands = _items(spark, d).select("brand").distinct().withColumn("word", F.explode(F.array(*(F.lit(w) for w in ("ring", "widget", "bolt", "gear")))))
    far = brands.join(best, "word").where("own <> brand").join(linked, ["brand", "review"], "left_anti")
    far = merge.top_by(far, scope=["brand", "word"], order=latest, limit=4).select("brand", "word", "review", "date", F.lit(1).alias("far"))
    return merge.top_by(own.unionByName(far), scope=["brand", "word"], order=["far", *latest], limit=4).select("brand", "word", "review", "rank")


@R.add(f"WITH {_BASE}, f AS ({_TOLD.format(before=120, after=14, kinds=chr(39).join(('kind IN (', 'ECONOMY', ', ', 'SMALL', ')')))}) SELECT brand, count(*) AS matched FROM f GROUP BY 1")
def matched_by_brand(spark: SparkSession, d: str) -> DataFrame:
    return _launched(spark, d).groupBy("brand").agg(F.count(F.lit(1)).alias("matched"))


@R.add(f"WITH {_BASE}, f AS ({_TOLD.format(before=120, after=14, kinds=chr(39).join(('kind IN (', 'ECONOMY', ', ', 'SMALL', ')')))}) SELECT brand, partkey FROM i ANTI JOIN f USING (brand, partkey)")
def unmatched_items(spark: SparkSession, d: str) -> DataFrame:
    """What the next run tries again."""
    items = _items(spark, d).withColumns({"launch_date": F.lit(None).cast("string"), "is_regular": F.lit(False)})
    return match.unmatched(items, _launched(spark, d), keys=["brand", "partkey"]).select("brand", "partkey")


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@R.add("""WITH c AS (SELECT user_id AS k, ts::date AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS unknown FROM events GROUP BY ALL), j AS (SELECT *, greatest(1, floor(total * 0.25)::int) AS lim, row_number() OVER (PARTITION BY k ORDER BY day) AS n FROM c),
    h AS (SELECT *, unknown > lim AND n > 1 AS held FROM j), g AS (SELECT *, sum((NOT held)::int) OVER (PARTITION BY k ORDER BY day) AS grp FROM h), x AS (SELECT *, CASE WHEN held THEN sum(held::int) OVER (PARTITION BY k, grp ORDER BY day) ELSE 0 END AS hd FROM g)
    SELECT k, day::varchar AS day, total, unknown, lim AS "limit", held, hd::int AS hold_days, hd >= 2 AS escalated FROM x""")
def hold_escalation(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("k"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") == "error").alias("unknown"))
    return lifecycle.holds(counts, keys=["k"], date="day", total="total", unknown="unknown", escalate=2, floor=1).withColumn("day", F.col("day").cast("string"))
