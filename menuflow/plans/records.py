"""Queries over stored records: building, kinds, seasons, histories, queues, moves of keys, gated updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.functions import dates
from menuflow.operators import gates, lifecycle, merge, products, views
from menuflow.plans import observation
from menuflow.plans.observation import _LISTED
from menuflow.plans.registry import Registry
from menuflow.sources.tables import table

R = Registry()


@R.add(f"""WITH {_LISTED}, last AS (SELECT chain, max(run_date) AS run_date FROM listed GROUP BY chain), e AS (SELECT l.chain, pid, name, price FROM listed l JOIN last USING (chain, run_date)), d AS (SELECT chain, product_id AS pid, any_value(price) AS dp, any_value(official_url) AS url FROM products GROUP BY ALL)
    SELECT e.chain, e.pid AS product_id, name, coalesce(dp, price) AS price, url, 'on_sale' AS status, CASE WHEN coalesce(dp, price) IS NULL THEN 0 ELSE 1 END AS entries FROM e LEFT JOIN d ON d.chain = e.chain AND d.pid = e.pid""")
def built_products(spark: SparkSession, d: str) -> DataFrame:
    """Records out of the last listing's entries and the stored details."""
    rows = observation.listed(spark, d)
    last = rows.groupBy("chain").agg(F.max("run_date").alias("run_date"))
    entries = rows.join(last, ["chain", "run_date"]).select("chain", F.col("pid").alias("product_id"), "name", "price")
    details = table(spark, d, "products").select("chain", "product_id", "price", F.col("official_url").alias("url"))
    today = F.to_date(F.lit("2026-11-01"))
    found = products.build(entries, details, keys=["chain", "product_id"], now=today.cast("timestamp"), today=today)
    return found.select("chain", "product_id", "name", "price", "url", "status", F.size("price_history").alias("entries"))


@R.add("""SELECT record_id, CASE WHEN missed_runs = 0 THEN true END AS is_regular, CASE WHEN missed_runs <> 0 OR missed_runs IS NULL THEN CASE WHEN missed_runs IS NOT NULL THEN limited_kind END END AS limited_kind, CASE WHEN missed_runs <> 0 THEN launch_date END AS launch_date FROM products""")
def regular_marks(spark: SparkSession, d: str) -> DataFrame:
    return products.mark_regular(table(spark, d, "products"), F.col("missed_runs") == 0).select("record_id", "is_regular", "limited_kind", "launch_date")


@R.add("""SELECT record_id, CASE WHEN coalesce(is_regular, false) AND status = 'ended' THEN NULL ELSE is_regular END AS is_regular, CASE WHEN coalesce(is_regular, false) AND status = 'ended' THEN '期間限定' ELSE limited_kind END AS limited_kind FROM products""")
def regular_upgrades(spark: SparkSession, d: str) -> DataFrame:
    return products.upgrade_regular(table(spark, d, "products"), F.coalesce(F.col("status") == "ended", F.lit(False)), F.lit("期間限定")).select("record_id", "is_regular", "limited_kind")


@R.add("""WITH h AS (SELECT record_id, price, len(coalesce(price_history, [])) AS n, list_filter(coalesce(price_history, []), lambda e: e.price IS NOT NULL)[-1].price AS last FROM products WHERE price_history IS NOT NULL) SELECT record_id, n + CASE WHEN price IS NULL OR price IS NOT DISTINCT FROM last THEN 0 ELSE 1 END AS entries FROM h""")
def appended_prices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").where("price_history is not null")
    return p.select("record_id", F.size(products.append_price(F.col("price_history"), F.to_date(F.lit("2026-11-01")), F.col("price"))).alias("entries"))


@R.add("""SELECT record_id, CASE WHEN source = 'pdf' THEN price WHEN status = 'on_sale' THEN price END AS list_price FROM products""")
def gated_prices(spark: SparkSession, d: str) -> DataFrame:
    """The list price as far as it may enter the history: of complete runs only, but for one family."""
    complete = F.coalesce(F.col("status") == "on_sale", F.lit(False))
    free, gated = (products.list_price(F.col("price"), complete, products.FAMILIES[f]) for f in ("pdf_table", "list_html"))
    return table(spark, d, "products").select("record_id", F.when(F.col("source") == "pdf", free).otherwise(gated).alias("list_price"))


@R.add("""SELECT record_id, nullif(CASE WHEN price > 900 THEN '900円を超える' ELSE '' END || CASE WHEN status = 'ended' THEN '販売終了' ELSE '' END, '') AS note FROM products""")
def price_notes(spark: SparkSession, d: str) -> DataFrame:
    note = products.price_note((F.col("price") > 900, "900円を超える"), (F.col("status") == "ended", "販売終了"))
    return table(spark, d, "products").select("record_id", note.alias("note"))


@R.add("""WITH x AS (SELECT record_id, coalesce(status = 'ended' AND missed_runs = 0, false) OR coalesce(is_regular, false) AS back, price_history, launch_date FROM products WHERE price_history IS NOT NULL)
    SELECT record_id, CASE WHEN back THEN 1 ELSE 0 END AS seasons, len(price_history) + CASE WHEN back AND len(list_filter(price_history, lambda h: coalesce(h.relaunch, false) AND h.date = '2026-11-01')) = 0 THEN 1 ELSE 0 END AS entries, CASE WHEN NOT back THEN launch_date END AS launch_date FROM x""")
def new_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Items that are back: their launch and end go into seasons, the history takes a relaunch row."""
    p = table(spark, d, "products").where("price_history is not null").withColumn("seasons", F.lit(None).cast("array<struct<launch_date:string,ended:string>>"))
    back = F.coalesce((F.col("status") == "ended") & (F.col("missed_runs") == 0), F.lit(False)) | F.coalesce("is_regular", F.lit(False))
    found = products.new_season(p, back, F.to_date(F.lit("2026-11-01")))
    return found.select("record_id", F.greatest(F.size(F.coalesce("seasons", F.array().cast("array<struct<launch_date:string,ended:string>>"))), F.lit(0)).alias("seasons"), F.size("price_history").alias("entries"), "launch_date")


_SETS = """m AS (SELECT l_suppkey AS k, strftime(l_shipdate, '%Y') AS year, l_returnflag AS label, floor(min(l_extendedprice))::int AS price FROM lineitem GROUP BY ALL)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.date_format("l_shipdate", "yyyy").alias("year"), F.col("l_returnflag").alias("label")).agg(F.floor(F.min("l_extendedprice")).cast("int").alias("price"))
    return each.groupBy("k", "year").agg(F.array_sort(F.collect_list(F.struct("label", "price"))).alias("variants"))


@R.add(f"""WITH {_SETS}, s AS (SELECT k, year, string_agg(label || ' ' || price, ',' ORDER BY label) AS v FROM m GROUP BY ALL HAVING count(*) >= 2), x AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY year) AS o FROM s) SELECT k, year, o AS old, v AS new FROM x WHERE o <> v""")
def variant_changes(spark: SparkSession, d: str) -> DataFrame:
    found = products.variant_changes(_sets(spark, d), keys=["k"], at="year", variants="variants")
    told = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws(" ", v["label"], v["price"].cast("string"))), ",").alias(c)
    return found.select("k", "year", told("old"), told("new"))


@R.add(f"""WITH {_SETS}, e AS (SELECT k, year, row_number() OVER (PARTITION BY k ORDER BY year) AS n FROM (SELECT DISTINCT k, year FROM m)), x AS (SELECT m.*, e.n, row_number() OVER (PARTITION BY m.k, m.year ORDER BY label) AS pos FROM m JOIN e USING (k, year)),
    b AS (SELECT y.k, y.year AS date, NULL::varchar AS label, o.price AS old, y.price AS new FROM x y JOIN x o ON o.k = y.k AND o.n = y.n - 1 AND o.pos = 1 AND y.pos = 1 WHERE o.price <> y.price),
    v AS (SELECT y.k, y.year AS date, y.label, o.price AS old, y.price AS new FROM x y JOIN x o ON o.k = y.k AND o.n = y.n - 1 AND o.label = y.label WHERE o.price <> y.price)
    SELECT *, new - old AS diff FROM b UNION ALL SELECT *, new - old FROM v WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = v.k AND b.date = v.date AND b.old = v.old AND b.new = v.new)""")
def variant_price_events(spark: SparkSession, d: str) -> DataFrame:
    """Price changes by label; one that only repeats the item's own is left out."""
    history = _sets(spark, d).groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("year").alias("date"), "variants"))).alias("variant_history"))
    return views.variant_price_events(history, keys=["k"])


@R.add(f"""WITH {_LISTED}, last AS (SELECT chain, max(run_date) AS run_date FROM listed GROUP BY chain), t AS (SELECT DISTINCT l.chain, pid FROM listed l JOIN last USING (chain, run_date)),
    q AS (SELECT p.chain, p.product_id, row_number() OVER (PARTITION BY p.chain ORDER BY last_seen_at NULLS FIRST, p.product_id) AS rank FROM products p JOIN t ON t.chain = p.chain AND t.pid = p.product_id WHERE status = 'on_sale' AND coalesce(last_seen_at <> date '2026-03-22', true)) SELECT chain, product_id, rank FROM q WHERE rank <= 20""")
def listed_rechecks(spark: SparkSession, d: str) -> DataFrame:
    """What to check again: on sale, listed in the last run, not checked on the day."""
    rows = observation.listed(spark, d)
    last = rows.groupBy("chain").agg(F.max("run_date").alias("run_date"))
    seen = rows.join(last, ["chain", "run_date"]).select("chain", F.col("pid").alias("product_id"))
    return merge.recheck_queue(table(spark, d, "products"), seen, scope=["chain"], key="product_id", checked="last_seen_at", today=F.to_date(F.lit("2026-03-22")), limit=20)


@R.add("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice, p_partkey) AS n FROM part) SELECT p_brand AS brand, p_partkey AS k, CASE WHEN n > 5 THEN 'deferred' WHEN p_type = 'PROMO' THEN 'failed' ELSE 'created' END AS outcome FROM f""")
def creations(spark: SparkSession, d: str) -> DataFrame:
    """New items in listing order; failures use up the budget, the rest is deferred."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"), "p_size", "p_retailprice", "p_type")
    return merge.creations(p, p.where("p_type = 'PROMO'"), scope=["brand"], key="k", order=["p_size", "p_retailprice"], limit=5)


_KEYS = """p AS (SELECT DISTINCT chain, product_id AS k, record_id, first_seen_at AS b FROM products), m AS (SELECT DISTINCT chain, k AS old, regexp_replace(k, '_[0-9]{6}$', '') AS new FROM p WHERE regexp_matches(k, '_[0-9]{6}$')),
    t AS (SELECT p.chain, k, record_id, b, coalesce(new, k) AS target FROM p LEFT JOIN m ON m.chain = p.chain AND m.old = p.k), r AS (SELECT *, count(*) OVER (PARTITION BY chain, target) AS n, row_number() OVER (PARTITION BY chain, target ORDER BY b NULLS FIRST, k) AS r FROM t)"""


@R.add(f"WITH {_KEYS} SELECT chain, k AS product_id, CASE WHEN r > 1 THEN 'delete' WHEN n > 1 THEN 'merge' WHEN target <> k THEN 'rename' ELSE 'keep' END AS action, target FROM r")
def key_migration(spark: SparkSession, d: str) -> DataFrame:
    """Keys lose their dates: which records are renamed, merged or deleted as false new ones."""
    p = table(spark, d, "products")
    moves = p.where(F.col("product_id").rlike("_[0-9]{6}$")).select("chain", F.col("product_id").alias("old"), F.regexp_replace("product_id", "_[0-9]{6}$", "").alias("new"))
    return merge.migrate_keys(p, moves, scope=["chain"], key="product_id", born="first_seen_at")


_RUN = """r AS (SELECT *, ok AND http_status = 200 AS good FROM snapshot_runs), h AS (SELECT chain, arg_max(run_seq, (run_date, run_seq)) AS sig FROM r GROUP BY 1), s AS (SELECT chain, arg_min(run_seq, (run_date, run_seq)) AS sig, CASE WHEN count(*) > 26 THEN 1 END AS bad FROM r GROUP BY 1),
    due AS (SELECT h.chain, h.sig FROM h JOIN s USING (chain) WHERE h.sig IS DISTINCT FROM s.bad AND h.sig <> s.sig), g AS (SELECT chain, count(*) AS n, round(avg(coalesce(good, false)::int), 6) AS p FROM r GROUP BY 1)"""


def _update(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "snapshot_runs").withColumn("good", F.col("ok") & (F.col("http_status") == 200))
    at = F.struct("run_date", "run_seq")
    heads = r.groupBy("chain").agg(F.max_by("run_seq", at).alias("sig"))
    state = r.groupBy("chain").agg(F.min_by("run_seq", at).alias("sig"), F.lit(None).cast("date").alias("checked"), F.when(F.count(F.lit(1)) > 26, 1).alias("bad_signature"))
    return gates.update_run(heads, state, r, key="chain", signature="sig", ok=F.col("good"), complete=F.lit(True), today=F.to_date(F.lit("2026-11-01")), rows_least=20)


@R.add(f"WITH {_RUN} SELECT chain, count(*) AS rows FROM r WHERE chain IN (SELECT chain FROM due JOIN g USING (chain) WHERE n >= 20 AND p >= 0.8) GROUP BY 1")
def update_applied(spark: SparkSession, d: str) -> DataFrame:
    return _update(spark, d)[0].groupBy("chain").agg(F.count(F.lit(1)).alias("rows"))


@R.add(f"""WITH {_RUN} SELECT s.chain, CASE WHEN due.chain IS NULL THEN s.sig WHEN n >= 20 AND p >= 0.8 THEN due.sig END AS sig, CASE WHEN due.chain IS NOT NULL THEN '2026-11-01' END AS checked, CASE WHEN due.chain IS NULL THEN s.bad WHEN n >= 20 AND p >= 0.8 THEN NULL ELSE due.sig END AS bad_signature FROM s LEFT JOIN due ON due.chain = s.chain LEFT JOIN g ON g.chain = s.chain""")
def update_state(spark: SparkSession, d: str) -> DataFrame:
    """What a run over changed sources remembers of each."""
    return _update(spark, d)[1].withColumn("checked", F.col("checked").cast("string"))


_FRESH = f"""{_LISTED}, born AS (SELECT chain, pid, min(run_date) AS born FROM listed GROUP BY ALL), c AS (SELECT l.chain, l.run_date, count(*) AS total, count(*) FILTER (born = l.run_date) AS fresh FROM listed l JOIN born USING (chain, pid) GROUP BY ALL),
    j AS (SELECT *, greatest(4, floor(total * 0.08)::int) AS lim, row_number() OVER (PARTITION BY chain ORDER BY run_date) AS n FROM c)"""


@R.add(f"""WITH {_FRESH} SELECT l.chain, l.run_date::varchar AS run_date, NOT (fresh > lim AND n > 1) AS list_ok, count(*) AS rows FROM listed l JOIN j ON j.chain = l.chain AND j.run_date = l.run_date JOIN born b ON b.chain = l.chain AND b.pid = l.pid WHERE NOT (fresh > lim AND n > 1) OR born < l.run_date GROUP BY ALL""")
def held_listings(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each listing as far as they may be applied: held runs keep the items that were known before them."""
    rows = observation.listed(spark, d).select("chain", "run_date", F.col("pid").alias("product_id"))
    judged = lifecycle.holds(observation._counts(spark, d), keys=["chain"], date="run_date", total="total", unknown="fresh", floor=4, share=0.08)
    born = rows.groupBy("chain", "product_id").agg(F.min("run_date").alias("born"))
    dated = rows.join(born, ["chain", "product_id"])
    # known to a run: seen on an earlier day, so the key holds the day as well
    key = F.concat_ws(" ", "product_id", F.col("run_date").cast("string"))
    known = dated.where("born < run_date").select("chain", key.alias("_item"))
    kept = lifecycle.held_rows(dated.withColumn("_item", key), judged, known, keys=["chain"], date="run_date", key="_item")
    return kept.groupBy("chain", F.col("run_date").cast("string").alias("run_date"), "list_ok").agg(F.count(F.lit(1)).alias("rows"))


@R.add("""SELECT record_id, CASE WHEN status = 'ended' AND date '2026-11-01' - ended_observed_at BETWEEN 0 AND 30 THEN 'recently_ended' WHEN status = 'ended' AND date '2026-11-01' - ended_observed_at BETWEEN 31 AND 44 THEN 'rematch' ELSE 'other' END AS recency FROM products""")
def recencies(spark: SparkSession, d: str) -> DataFrame:
    today = F.to_date(F.lit("2026-11-01"))
    recency = F.when(merge.ended_within(F.col("status"), F.col("ended_observed_at"), today, 30), "recently_ended").when(merge.ended_within(F.col("status"), F.col("ended_observed_at"), today, 44), "rematch").otherwise("other")
    return table(spark, d, "products").select("record_id", recency.alias("recency"))


@R.add("""SELECT record_id FROM products WHERE NOT coalesce(regexp_matches(name, 'セット|追加|単品$'), false) AND NOT coalesce(category IN ('トッピング', 'ドリンク'), false) AND NOT coalesce(price <= 130, false)""")
def excluded_items(spark: SparkSession, d: str) -> DataFrame:
    """Records without sets, additions, some categories and very small prices."""
    return merge.without(table(spark, d, "products"), name="name", words="セット|追加|単品$", category="category", categories=["トッピング", "ドリンク"], price="price", least_price=131).select("record_id")


@R.add(r"""SELECT doc_id FROM documents WHERE (contains(text, '販売') OR contains(text, 'menu')) AND NOT contains(text, '終了')""")
def chosen_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with any of some words and none of others."""
    return table(spark, d, "documents").where(merge.told(F.col("text"), ["販売", "menu"], ["終了"])).select("doc_id")


@R.add(r"""SELECT record_id, regexp_matches(regexp_extract(product_id, '([0-9]+)$', 1), '^[0-9]{6}$') AS dated FROM products""")
def dated_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("record_id", dates.is_dated(F.regexp_extract("product_id", "([0-9]+)$", 1), r"[0-9]{6}").alias("dated"))


@R.add("""SELECT '<item><title>' || replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</title><link>/item/' || record_id || '/</link><pubDate>' || strftime(first_seen_at, '%a, %d %b %Y %H:%M:%S') || ' +0900</pubDate><description>' || coalesce(category, '') || '</description></item>' AS xml FROM products WHERE name IS NOT NULL AND first_seen_at IS NOT NULL""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").where("name is not null and first_seen_at is not null")
    link = F.concat(F.lit("/item/"), F.col("record_id").cast("string"), F.lit("/"))
    return p.select(views.feed_xml(F.col("name"), link, F.col("first_seen_at"), F.coalesce("category", F.lit(""))).alias("xml"))


@R.add(r"""SELECT record_id, replace('{"name":' || to_json(name) || ',"price":' || price || '}', '<', '\u003c') AS ld FROM products WHERE name IS NOT NULL AND price IS NOT NULL""")
def linked_data(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").where("name is not null and price is not null")
    return p.select("record_id", views.json_ld(name=F.col("name"), price=F.col("price")).alias("ld"))


@R.add("""WITH old AS (SELECT user_id, 'not_found' AS reason FROM events WHERE event_type = 'view' GROUP BY 1), new AS (SELECT user_id, CASE WHEN count(*) > 10 THEN 'fetch_error' ELSE 'empty_detail' END AS reason FROM events WHERE event_type = 'error' GROUP BY 1), done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 95)
    SELECT user_id, coalesce(new.reason, old.reason) AS reason FROM old FULL JOIN new USING (user_id) WHERE user_id NOT IN (SELECT user_id FROM done)""")
def pending_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures that are still open after a run, with their reasons: new ones replace old ones, successes remove them."""
    e = table(spark, d, "events")
    pending = e.where("event_type = 'view'").select("user_id", F.lit("not_found").alias("reason")).distinct()
    failed = e.where("event_type = 'error'").groupBy("user_id").agg(F.when(F.count(F.lit(1)) > 10, "fetch_error").otherwise("empty_detail").alias("reason"))
    return merge.dead_letters(pending, failed, e.where("event_type = 'purchase' and value > 95").select("user_id").distinct(), keys=["user_id"])


@R.add("""SELECT chain, category, record_id, row_number() OVER (PARTITION BY chain ORDER BY (category IS NULL), category, first_seen_at DESC NULLS LAST, record_id) AS pos FROM products""")
def category_groups(spark: SparkSession, d: str) -> DataFrame:
    """The items of a chain by category, unnamed ones last, newest first; places are counted by category and shifted, so no chain is one task."""
    p = table(spark, d, "products").select("chain", "category", "record_id", "first_seen_at")
    return views.places(p, scope=["chain"], group="category", order=[F.desc_nulls_last("first_seen_at"), "record_id"]).select("chain", "category", "record_id", "pos")


@R.add("""WITH x AS (SELECT chain, product_id, any_value(status) AS status FROM products GROUP BY ALL), s AS (SELECT chain, count(*) FILTER (NOT coalesce(ok, false)) AS failed, count(*) FILTER (http_status IN (401, 403, 429)) AS blocked FROM snapshot_runs GROUP BY 1)
    SELECT chain, CASE WHEN blocked > 0 THEN 'high' WHEN failed > 2 THEN 'default' ELSE 'low' END AS priority, CASE WHEN blocked > 0 THEN 1 ELSE 0 END AS exit_code FROM s""")
def run_priorities(spark: SparkSession, d: str) -> DataFrame:
    """How urgent a run's message is and what it exits with."""
    runs = table(spark, d, "snapshot_runs").groupBy("chain").agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.count_if(F.col("http_status").isin(401, 403, 429)).alias("blocked"))
    return views.run_priority(runs, blocked="blocked", failed="failed", many=2).select("chain", "priority", "exit_code")
