"""Queries over stored items and texts: groups, feeds, matching, text functions, page geometry, extras."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.functions import dates, text
from menuflow.operators import extract, geometry, match, merge, views
from menuflow.plans.registry import Registry
from menuflow.sources import landed
from menuflow.sources.tables import table

R = Registry()


@R.add("""SELECT p_brand AS brand, p_name AS name, count(DISTINCT p_partkey) AS n, string_agg(p_partkey::varchar, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1""")
def same_name_siblings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), "p_partkey")
    return match.siblings(rows, group=["brand", "name"], key="p_partkey").withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@R.add("""SELECT p_brand AS brand, p_name AS name, count(*) AS n, CASE WHEN count(DISTINCT p_type) = count(*) THEN 'p_type' WHEN count(DISTINCT p_size) = count(*) THEN 'p_size' WHEN count(DISTINCT p_retailprice) = count(*) THEN 'p_retailprice' END AS label
    FROM part GROUP BY ALL HAVING count(*) > 1""")
def distinguishing_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumnsRenamed({"p_brand": "brand", "p_name": "name"})
    return match.distinguishing(rows, group=["brand", "name"], labels=["p_type", "p_size", "p_retailprice"])


@R.add("""WITH p AS (SELECT p_brand AS brand, p_partkey AS k, p_retailprice AS v FROM part), x AS (SELECT a.brand, a.k, b.k AS near, abs(b.v - a.v) AS distance FROM p a JOIN p b ON a.brand = b.brand AND a.k <> b.k),
    r AS (SELECT *, row_number() OVER (PARTITION BY brand, k ORDER BY distance, near) AS rank FROM x) SELECT brand, k AS partkey, near, round(distance, 4) AS distance, rank FROM r WHERE rank <= 6""")
def related_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), "p_retailprice")
    return match.nearest(rows, scope=["brand"], value="p_retailprice", key="partkey", k=6).withColumn("distance", F.round("distance", 4))


@R.add("""WITH p AS (SELECT p_brand AS brand, p_partkey AS k, p_type AS g, p_retailprice AS v FROM part), x AS (SELECT a.brand, a.k, b.k AS near, row_number() OVER (PARTITION BY a.brand, a.k ORDER BY a.g <> b.g, abs(b.v - a.v), b.k) AS rank FROM p a JOIN p b ON a.brand = b.brand AND a.k <> b.k)
    SELECT brand, k AS partkey, near, rank FROM x WHERE rank <= 6""")
def related_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Related items: those of the same type first, then the nearest."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), "p_type", "p_retailprice")
    return match.related(rows, scope=["brand"], group="p_type", value="p_retailprice", key="partkey", k=6)


_LATEST = """WITH i AS (SELECT DISTINCT l_suppkey % 1000 AS k, l_shipdate::date AS ref FROM lineitem), n AS (SELECT o_custkey % 1000 AS k, o_orderdate::date AS date, o_orderkey AS id FROM orders)
    SELECT i.k, ref::varchar AS ref, max(date)::varchar AS date, arg_max(id, (date, id)) AS id FROM i JOIN n ON i.k = n.k AND n.date BETWEEN ref - 120 AND ref + 14 GROUP BY ALL"""


def _dated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "lineitem").select((F.col("l_suppkey") % 1000).alias("k"), F.to_date("l_shipdate").alias("ref")).distinct()
    news = table(spark, d, "orders").select((F.col("o_custkey") % 1000).alias("k"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("id"))
    return items, news


@R.add(_LATEST)
def latest_in_window_binned(spark: SparkSession, d: str) -> DataFrame:
    items, news = _dated(spark, d)
    found = match.latest_in_window_binned(items, news, on=["k"], reference="ref", date="date", before=120, after=14, keys=[], tie=["id"])
    return found.withColumns({c: F.col(c).cast("string") for c in ("ref", "date")})


@R.add("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate::date AS ends, o_orderstatus = 'O' AND o_totalprice > 450000 AS open FROM orders), i AS (SELECT c_custkey AS k, date '1998-06-01' AS ref FROM customer),
    c AS (SELECT * FROM i WHERE k NOT IN (SELECT k FROM e WHERE open))
    SELECT c.k AS custkey, max(ends)::varchar AS ends, max(id) AS event FROM c JOIN e ON e.k = c.k AND NOT open AND ends >= ref GROUP BY c.k HAVING count(DISTINCT ends) = 1""")
def end_event_unique(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("ends"), ((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 450000)).alias("open"))
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_custkey").alias("k"), F.to_date(F.lit("1998-06-01")).alias("ref"))
    found = match.unique_end(items, events, on=["k"], keys=["custkey"], reference="ref", end="ends", is_open=F.col("open"), event_id="id")
    return found.select("custkey", F.col("end").cast("string").alias("ends"), "event")


@R.add("SELECT DISTINCT ref_id, doc_id FROM menu_reference JOIN documents ON contains(text, canonical_name) WHERE length(canonical_name) >= 6")
def containment_match(spark: SparkSession, d: str) -> DataFrame:
    return match.contained_in(table(spark, d, "menu_reference"), table(spark, d, "documents"), name="canonical_name", text="text", name_keys=["ref_id"], text_keys=["doc_id"])


@R.add("""WITH q AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '[「『](.*?)[」』]', 1)) AS q FROM documents) SELECT DISTINCT a.q AS name, b.doc_id FROM q a JOIN q b ON a.q = b.q WHERE a.source = 'news' AND b.source <> 'news'""")
def quoted_matches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    announced = documents.where("source = 'news'").select(F.explode(text.quotes(F.col("text"))).alias("name")).distinct()
    return match.quoted_matches(announced, documents.where("source <> 'news'"), name="name", quotes=text.quotes(F.col("text")), item_keys=["name"], news_keys=["doc_id"])



@R.add("""WITH w AS (SELECT unnest(['カレー', '四川麻婆', '麻婆', 'チーズ', 'バジル', 'チキン', '照り焼き']) AS word, unnest([1, 2, 3, 4, 5, 6, 7]) AS o),
    h AS (SELECT ref_id, word, row_number() OVER (PARTITION BY ref_id ORDER BY length(word) DESC, o) AS n FROM menu_reference JOIN w ON contains(canonical_name, word) WHERE NOT (word = 'チーズ' AND contains(canonical_name, 'サラダ')))
    SELECT ref_id, word AS keyword FROM h WHERE n = 1""")
def keyword_longest(spark: SparkSession, d: str) -> DataFrame:
    words = {w: w for w in ("カレー", "四川麻婆", "麻婆", "チーズ", "バジル", "チキン", "照り焼き")}
    label = text.longest_word(F.col("canonical_name"), words, exclude={"チーズ": ["サラダ"]})
    return table(spark, d, "menu_reference").select("ref_id", label.alias("keyword")).where("keyword is not null")


@R.add("""WITH s AS (SELECT p_name AS name, p_brand AS brand, min(p_type) AS t FROM part GROUP BY ALL HAVING count(DISTINCT p_type) = 1), u AS (SELECT DISTINCT p_name AS name, p_brand AS brand, p_size AS size FROM part) SELECT u.name, brand, size, t AS type FROM u JOIN s USING (name, brand)""")
def ambiguity_veto_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    return match.unless_ambiguous(p.select("name", "brand", "size").distinct(), p, on=["name", "brand"], values=["type"])


@R.add("""WITH m AS (SELECT DISTINCT e.entry_id, r.ref_id FROM name_entries e JOIN menu_reference r ON r.chain = e.chain AND r.canonical_name = e.name), x AS (SELECT ref_id, entry_id, row_number() OVER (PARTITION BY ref_id ORDER BY entered_at DESC, entry_id) AS rank
    FROM m JOIN (SELECT entry_id, max(entered_at) AS entered_at FROM name_entries GROUP BY 1) USING (entry_id)) SELECT * FROM x WHERE rank <= 4""")
def latest_linked(spark: SparkSession, d: str) -> DataFrame:
    e, r = table(spark, d, "name_entries"), table(spark, d, "menu_reference").select("ref_id", "chain", F.col("canonical_name").alias("name"))
    linked = e.join(r, ["chain", "name"]).groupBy("ref_id", "entry_id").agg(F.lit(1).alias("_"))
    at = e.groupBy("entry_id").agg(F.max("entered_at").alias("entered_at"))
    return merge.top_by(linked.join(at, "entry_id"), scope=["ref_id"], order=[F.desc("entered_at"), "entry_id"], limit=4).select("ref_id", "entry_id", "rank")


@R.add(r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+') AS l FROM documents) SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS link FROM x WHERE len(l) > 0""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = extract.Field("links", r"(https?://[A-Za-z0-9./_-]+)", "list")
    return table(spark, d, "documents").select("doc_id", F.posexplode(links.column(F.col("text"))).alias("pos", "link"))


@R.add(r"""SELECT record_id, lower(regexp_extract(official_url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1)) AS scheme, regexp_replace(lower(regexp_extract(official_url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2)), '^(www|m)\.', '') AS host,
    regexp_extract(official_url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) AS path FROM products WHERE official_url IS NOT NULL""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").where("official_url is not null").select("record_id", text.url_parts(F.col("official_url")).alias("u")).select("record_id", "u.scheme", "u.host", "u.path")


@R.add("SELECT event_type, (props->>'k')::bigint AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_id, (props->>'k')::bigint AS k, -1::bigint AS missing FROM events")
def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Values of JSON texts, and the default where they can't be read."""
    read = lambda c, schema: landed.json_or(c, schema, F.struct(F.lit(-1).cast("bigint").alias("k")))["k"]
    return table(spark, d, "events").select("event_id", read(F.col("props"), "k bigint").alias("k"), read(F.lit(None).cast("string"), "k bigint").alias("missing"))


@R.add(r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '^(?:【[^】]*】\s*)+', ''), chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '' AND NOT starts_with(l, '※') AND NOT regexp_matches(l, '^【[^】]*】'))[1] AS t FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CASE WHEN instr(t, '。') > 0 THEN substr(t, 1, instr(t, '。')) ELSE t END AS s FROM x) SELECT doc_id, CASE WHEN length(s) > 100 THEN rtrim(substr(s, 1, 99), ' ') || '…' ELSE s END AS sentence FROM s""")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@R.add(r"SELECT p_brand AS brand, regexp_replace(lower(p_name), '[\s-]+', '', 'g') AS key, count(*) AS n FROM part GROUP BY ALL")
def name_norm_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), text.review_key(F.col("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""SELECT ref_id, CASE WHEN regexp_matches(canonical_name, '麺|そば|うどん|ラーメン|パスタ') THEN 'noodles' WHEN regexp_matches(canonical_name, '丼|飯|粥|リゾット|弁当') THEN 'rice' WHEN regexp_matches(canonical_name, 'サンド|バーガー') THEN 'bread' WHEN contains(canonical_name, '鍋') THEN NULL ELSE 'other' END AS icon FROM menu_reference""")
def ordered_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [("麺|そば|うどん|ラーメン|パスタ", "noodles"), ("丼|飯|粥|リゾット|弁当", "rice"), ("サンド|バーガー", "bread"), ("鍋", None)]
    return table(spark, d, "menu_reference").select("ref_id", text.first_rule(F.col("canonical_name"), rules, "other").alias("icon"))


@R.add("""WITH x AS (SELECT DISTINCT o_orderdate::date AS ref, month(l_shipdate) AS m, day(l_shipdate) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    y AS (SELECT *, try_cast(year(ref) || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS date) AS same, try_cast((year(ref) - 1) || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS date) AS before, try_cast((year(ref) + 1) || '-' || lpad(m::varchar, 2, '0') || '-' || lpad(d::varchar, 2, '0') AS date) AS after FROM x)
    SELECT ref::varchar AS ref, m, d, (CASE WHEN same - ref > 200 THEN before WHEN same - ref < -200 THEN after ELSE same END)::varchar AS date FROM y""")
def yearless_date(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = rows.select(F.to_date("o_orderdate").alias("ref"), F.month("l_shipdate").alias("m"), F.dayofmonth("l_shipdate").alias("d")).distinct()
    return x.select(F.col("ref").cast("string").alias("ref"), "m", "d", dates.yearless_date(F.col("m"), F.col("d"), F.col("ref")).cast("string").alias("date"))


@R.add("""SELECT chain, record_id, row_number() OVER (PARTITION BY chain ORDER BY first_seen_at DESC, name DESC, record_id) AS pos FROM products WHERE status = 'on_sale'""")
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").where("status = 'on_sale'").withColumn("_month", -(F.year("first_seen_at") * 12 + F.month("first_seen_at")))
    return views.places(p, scope=["chain"], group="_month", order=[F.desc("first_seen_at"), F.desc("name"), "record_id"]).select("chain", "record_id", "pos")


@R.add("SELECT strftime(first_seen_at, '%Y-%m') AS month, count(*) AS n FROM products WHERE status = 'ended' AND first_seen_at IS NOT NULL GROUP BY 1")
def archive_months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").where("status = 'ended' and first_seen_at is not null").groupBy(dates.month_of(F.col("first_seen_at")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@R.add("""WITH p AS (SELECT chain, strftime(first_seen_at, '%Y-%m') AS month, greatest(first_seen_at::date, last_seen_at, ended_observed_at) AS lastmod FROM products)
    SELECT CASE WHEN grouping(chain) = 1 AND grouping(month) = 1 THEN '/' WHEN grouping(chain) = 0 THEN '/chain/' || coalesce(chain, '') ELSE '/archive/' || coalesce(month, '') END AS page, max(lastmod)::varchar AS lastmod, count(*) AS n FROM p GROUP BY GROUPING SETS ((), (chain), (month))""")
def page_lastmod(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products")
    items = p.select("chain", dates.month_of(F.col("first_seen_at")).alias("month"), views.latest_date(F.to_date("first_seen_at"), F.col("last_seen_at"), F.col("ended_observed_at")).alias("lastmod"))
    return views.page_lastmod(items, chain="chain", month="month", lastmod="lastmod").withColumn("lastmod", F.col("lastmod").cast("string"))


_INDEX = "i AS (SELECT name AS n, '/item/' || p.chain || '-' || product_id || '/' AS u, p.chain AS c, chain_name AS cn, coalesce(strftime(first_seen_at, '%Y-%m-%d'), '') AS d, status AS s FROM products p JOIN chains c ON c.chain = p.chain)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").join(table(spark, d, "chains").select("chain", "chain_name"), "chain")
    url = F.concat(F.lit("/item/"), F.col("chain"), F.lit("-"), F.col("product_id"), F.lit("/"))
    return views.search_rows(p, name=F.col("name"), url=url, chain=F.col("chain"), chain_name=F.col("chain_name"), date=F.coalesce(F.date_format("first_seen_at", "yyyy-MM-dd"), F.lit("")), status=F.col("status"))


@R.add(f"WITH {_INDEX} SELECT * FROM i")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@R.add(f"WITH {_INDEX} SELECT n, u, c FROM i WHERE contains(lower(n), 'premium') ORDER BY n COLLATE C, u LIMIT 50")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return views.search(_index(spark, d), "Premium", order=["n", "u"], limit=50).select("n", "u", "c")


@R.add("SELECT record_id, name, first_seen_at::varchar AS first_seen FROM products ORDER BY first_seen_at DESC NULLS LAST, record_id LIMIT 100")
def feed_top100(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").orderBy(F.desc_nulls_last("first_seen_at"), "record_id").limit(100)
    return p.select("record_id", "name", F.date_format("first_seen_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


@R.add("""SELECT '/item/' || record_id || '/' AS url, greatest(last_seen_at, ended_observed_at)::varchar AS lastmod, '<url><loc>/item/' || record_id || '/</loc>' || coalesce('<lastmod>' || greatest(last_seen_at, ended_observed_at)::varchar || '</lastmod>', '') || '</url>' AS xml FROM products""")
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("/item/"), F.col("record_id").cast("string"), F.lit("/"))
    rows = table(spark, d, "products").select(url.alias("url"), views.latest_date(F.col("last_seen_at"), F.col("ended_observed_at")).alias("lastmod"))
    return rows.select("url", F.col("lastmod").cast("string").alias("lastmod"), views.sitemap_xml(F.col("url"), F.col("lastmod")).alias("xml"))


@R.add("""SELECT chain, count(*) AS items, count(*) FILTER (status = 'on_sale') AS on_sale, count(*) FILTER (status = 'ended') AS ended, count(*) FILTER (limited_kind IS NOT NULL) AS limited, min(first_seen_at::date)::varchar AS recorded_from FROM products GROUP BY 1""")
def chain_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").groupBy("chain").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "on_sale").alias("on_sale"), F.count_if(F.col("status") == "ended").alias("ended"), F.count_if(F.col("limited_kind").isNotNull()).alias("limited"), F.min(F.to_date("first_seen_at")).cast("string").alias("recorded_from")
    )


@R.add("""WITH r AS (SELECT chain, count(*) FILTER (http_status IN (401, 403, 429)) AS blocked, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(*) AS n FROM snapshot_runs GROUP BY 1)
    SELECT chain, CASE WHEN blocked > 3 THEN 'blocked' WHEN failed * 4 > n THEN 'list_failed' WHEN failed > 0 THEN 'errors' END AS problem, failed FROM r""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "snapshot_runs").groupBy("chain").agg(F.count_if(F.col("http_status").isin(401, 403, 429)).alias("blocked"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("blocked") > 3, "blocked").when(F.col("failed") * 4 > F.col("n"), "list_failed").when(F.col("failed") > 0, "errors")
    return r.select("chain", problem.alias("problem"), "failed")


@R.add("""WITH r AS (SELECT chain, count(*) FILTER (NOT coalesce(ok, false)) AS failed FROM snapshot_runs GROUP BY 1) SELECT sum(failed)::bigint AS failed, count(*) FILTER (failed > 0) AS chains, string_agg(chain || ' ' || failed, ' / ' ORDER BY chain) FILTER (failed > 0) AS message FROM r""")
def run_message(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "snapshot_runs").groupBy("chain").agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))
    part = F.when(F.col("failed") > 0, F.struct("chain", F.concat_ws(" ", "chain", F.col("failed").cast("string")).alias("t")))
    return r.agg(F.sum("failed").alias("failed"), F.count_if(F.col("failed") > 0).alias("chains"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), " / ").alias("message"))


@R.add("""WITH x AS (SELECT record_id, CASE WHEN regexp_full_match(launch_date, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(launch_date AS date) END AS launch,
    (SELECT max(CASE WHEN h.relaunch THEN h.date END) FROM (SELECT unnest(price_history) AS h)) AS re, first_seen_at::date AS seen FROM products)
    SELECT record_id, coalesce(launch, re::date, seen)::varchar AS effective FROM x""".replace("\\\\", "\\"))
def effective_dates(spark: SparkSession, d: str) -> DataFrame:
    back = F.array_max(F.transform(F.filter("price_history", lambda h: h["relaunch"]), lambda h: h["date"])).try_cast("date")
    launch = F.when(F.col("launch_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("launch_date")).try_cast("date")
    return table(spark, d, "products").select("record_id", dates.effective_date(launch, back, F.col("first_seen_at")).cast("string").alias("effective"))


@R.add("""WITH p AS (SELECT chain, name, first_seen_at, record_id, row_number() OVER (PARTITION BY chain, name ORDER BY first_seen_at DESC NULLS LAST, record_id) AS k FROM products WHERE name IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY first_seen_at DESC NULLS LAST, record_id) AS n FROM p WHERE k = 1),
    g AS (SELECT chain, list(name ORDER BY n) AS names FROM r WHERE n <= 3 GROUP BY 1)
    SELECT chain, CASE WHEN length(chain || ': ' || array_to_string(names, '、')) <= 60 THEN chain || ': ' || array_to_string(names, '、') WHEN length(chain || ': ' || array_to_string(names[1:2], '、')) <= 60 THEN chain || ': ' || array_to_string(names[1:2], '、')
    WHEN length(chain || ': ' || names[1]) <= 60 THEN chain || ': ' || names[1] ELSE chain || ': ' END AS description FROM g""")
def page_descriptions(spark: SparkSession, d: str) -> DataFrame:
    newest = [F.desc_nulls_last("first_seen_at"), "record_id"]
    p = table(spark, d, "products").where("name is not null").select("chain", "name", "first_seen_at", "record_id")
    distinct = merge.top_by(p, scope=["chain", "name"], order=newest, limit=1).drop("rank")
    top = merge.top_by(distinct, scope=["chain"], order=newest, limit=3)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return top.groupBy("chain").agg(names.alias("names")).select("chain", views.page_description(F.col("names"), F.concat("chain", F.lit(": ")), 60).alias("description"))


@R.add("""SELECT chain, status, count(*) AS visible FROM products WHERE contains(lower(name), 'l') GROUP BY ALL""")
def visible_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").where(F.contains(F.lower("name"), F.lit("l"))).groupBy("chain", "status").agg(F.count(F.lit(1)).alias("visible"))


@R.add("""WITH g AS (SELECT chain, count(*) AS n FROM products GROUP BY 1 HAVING count(*) > 12), r AS (SELECT *, row_number() OVER (ORDER BY chain) - 1 AS r, count(*) OVER () AS total FROM g)
    SELECT chain, n FROM r WHERE total <= 3 OR r IN (0, floor(total / 3.0), floor(2 * total / 3.0))""")
def slot_plan(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "products").groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    return views.even_slots(g, n="n", order=["chain"]).select("chain", "n")


@R.add("""WITH x AS (SELECT DISTINCT p_brand AS brand, p_retailprice AS v FROM part), m AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY brand ORDER BY v) > 5)::int, 0) AS fresh FROM x),
    c AS (SELECT *, sum(fresh) OVER (PARTITION BY brand ORDER BY v) AS cluster FROM m) SELECT brand, cluster::int AS cluster, min(v) AS low, max(v) AS high, round(avg(v), 6) AS centre, count(*) AS n FROM c GROUP BY ALL""")
def cluster_1d(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_retailprice").distinct()
    return geometry.clusters(p, keys=["brand"], value="p_retailprice", tolerance=5.0).withColumn("centre", F.round("centre", 6))


@R.add("""WITH b AS (SELECT p_brand AS brand, (p_size // 10)::int AS band, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_size <= 30 GROUP BY ALL) SELECT p_partkey AS partkey, band FROM part JOIN b ON brand = p_brand AND p_retailprice >= lo AND p_retailprice < hi""")
def band_assign(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumnRenamed("p_brand", "brand")
    bands = p.where("p_size <= 30").groupBy("brand", F.floor(F.col("p_size") / 10).cast("int").alias("band")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return geometry.assign_bands(p, bands, keys=["brand"], value="p_retailprice", low="lo", high="hi", width=100.0).select(F.col("p_partkey").alias("partkey"), "band")


@R.add("""WITH t AS (SELECT p_brand AS brand, p_partkey AS t, p_retailprice AS x FROM part WHERE p_size < 10), p AS (SELECT p_brand AS brand, p_partkey AS k, p_retailprice AS v FROM part WHERE p_size >= 10),
    y AS (SELECT p.brand, k, t.t AS t, abs(v - t.x) AS d, row_number() OVER (PARTITION BY p.brand, k ORDER BY abs(v - t.x), t.t) AS n FROM p JOIN t ON t.brand = p.brand AND abs(v - t.x) <= 7) SELECT brand, k AS partkey, t AS target, round(d, 6) AS distance FROM y WHERE n = 1""")
def nearest_assign(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("partkey"), F.col("p_retailprice").alias("v"), "p_size")
    targets = p.where("p_size < 10").select("brand", F.col("partkey").alias("target"), F.col("v").alias("at"))
    found = geometry.nearest(p.where("p_size >= 10"), targets, keys=["brand"], point="partkey", value="v", target="target", at="at", most=7.0)
    return found.withColumn("distance", F.round("distance", 6))


@R.add("""WITH x AS (SELECT *, coalesce((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800)::int, 0) AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM x),
    g AS (SELECT user_id, sess, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY 1""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@R.add("SELECT strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M') AS at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("at"), "event_type", "n", "total")


@R.add("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS line, count(*) AS n, sum(l_quantity)::bigint AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    return g.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("line"), "n", "quantity")


@R.add(r"""SELECT record_id, nullif(regexp_extract(regexp_extract(product_id, '_(\d{6})', 1), '^(\d{2})', 1), '') AS yy, try_cast('20' || substr(regexp_extract(product_id, '_(\d{6})', 1), 1, 2) || '-' || substr(regexp_extract(product_id, '_(\d{6})', 1), 3, 2) || '-' || substr(regexp_extract(product_id, '_(\d{6})', 1), 5, 2) AS date)::varchar AS dated,
    regexp_replace(product_id, '_\d{6}$', '') AS base FROM products""")
def key_dates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("product_id")
    return table(spark, d, "products").select("record_id", F.nullif(F.regexp_extract(c, r"_(\d{2})\d{4}", 1), F.lit("")).alias("yy"), dates.key_date(F.regexp_extract(c, r"(_\d{6})", 1)).cast("string").alias("dated"), text.base_key(c).alias("base"))


@R.add("""SELECT chain, category, count(*) AS n, round(avg(price), 4) AS mean_price, quantile_disc(price, 0.5) AS median_price FROM products WHERE price IS NOT NULL GROUP BY ALL""")
def category_prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").where("price is not null").groupBy("chain", "category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("mean_price"), F.percentile_approx("price", 0.5, 10_000).alias("median_price"))
