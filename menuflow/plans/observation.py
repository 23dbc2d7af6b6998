"""Queries over listings, runs and observations: changes, lifecycles, guards, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.functions.plain import plain_form
from menuflow.operators import gates, lifecycle, merge, snapshot_diff, views
from menuflow.plans.registry import Registry
from menuflow.sources.tables import table

R = Registry()
_W = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_H = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
def plain_sql(c: str) -> str:
    """The plain form of an identifier in SQL."""
    return rf"regexp_replace(lower(translate({c}, '{_W}', '{_H}')), '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


_RUNS = "runs AS (SELECT chain, run_date, max(run_seq) AS run_seq FROM snapshot_runs WHERE ok GROUP BY ALL)"
_LISTED = f"""{_RUNS},
    listed AS (
        SELECT DISTINCT ON (s.chain, s.run_date, pid) s.chain, s.run_date, {plain_sql("product_id")} AS pid, price, {plain_sql("status")} AS status, category, name, limited, is_new, badges
        FROM product_snapshots s JOIN runs USING (chain, run_date, run_seq) WHERE product_id IS NOT NULL
        ORDER BY s.chain, s.run_date, pid, page_ord, card_ord)"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    """The rows that count of every accepted snapshot: one per chain, date and product."""
    runs = snapshot_diff.accepted_runs(table(spark, d, "snapshot_runs")).select("chain", "run_date", "run_seq")
    rows = table(spark, d, "product_snapshots").where("product_id is not null").join(runs, ["chain", "run_date", "run_seq"])
    values = F.struct("page_ord", "card_ord", "price", plain_form(F.col("status")).alias("status"), "category", "name", "limited", "is_new", "badges")
    best = rows.groupBy("chain", "run_date", plain_form(F.col("product_id")).alias("pid")).agg(F.min(values).alias("_v"))
    return best.select("chain", "run_date", "pid", "_v.price", "_v.status", "_v.category", "_v.name", "_v.limited", "_v.is_new", "_v.badges")


def discounts(spark: SparkSession, d: str) -> DataFrame:
    """One observation per part and day: the smallest discount in percent."""
    rows = table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_discount") * 100).cast("bigint").alias("pct"))
    return rows.groupBy("l_partkey", "day").agg(F.min("pct").alias("pct"))


_DISCOUNTS = "daily AS (SELECT l_partkey, l_shipdate::date AS day, min(round(l_discount * 100)::bigint) AS pct FROM lineitem GROUP BY ALL)"


@R.add(f"""WITH {_DISCOUNTS}, x AS (SELECT *, lag(pct) OVER (PARTITION BY l_partkey ORDER BY day) AS old FROM daily)
    SELECT p_brand AS brand, l_partkey AS partkey, day::varchar AS day, old AS old_pct, pct AS new_pct FROM x JOIN part ON p_partkey = l_partkey WHERE old IS NULL OR old <> pct""")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    found = lifecycle.changes(discounts(spark, d), keys=["l_partkey"], at="day", value="pct", period=F.year("day"))
    parts = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("l_partkey"))
    return found.join(parts, "l_partkey").select(F.col("p_brand").alias("brand"), F.col("l_partkey").alias("partkey"), F.col("day").cast("string").alias("day"), F.col("old").alias("old_pct"), F.col("new").alias("new_pct"))


@R.add("""WITH e AS (SELECT chain, record_id, name, unnest(list_filter(coalesce(price_history, []), lambda x: x.price IS NOT NULL)) AS x, generate_subscripts(list_filter(coalesce(price_history, []), lambda x: x.price IS NOT NULL), 1) AS pos FROM products),
    p AS (SELECT *, lag(x.price) OVER (PARTITION BY record_id ORDER BY pos) AS old FROM e)
    SELECT chain, record_id, x.date AS date, old AS old_price, x.price AS new_price, x.price - old AS diff FROM p WHERE old <> x.price""")
def price_change_events(spark: SparkSession, d: str) -> DataFrame:
    found = views.price_events(table(spark, d, "products"), keys=["chain", "record_id"])
    return found.select("chain", "record_id", "date", F.col("old").alias("old_price"), F.col("new").alias("new_price"), "diff")


@R.add("""WITH m AS (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS month, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY ALL),
    x AS (SELECT *, lag(flags) OVER (PARTITION BY l_partkey ORDER BY month) AS old FROM m)
    SELECT l_partkey AS partkey, month, old AS old_set, flags AS new_set FROM x WHERE old IS NOT NULL AND old <> flags""")
def variant_set_changes(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "lineitem").groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    found = lifecycle.changes(sets, keys=["l_partkey"], at="month", value="flags")
    return found.where("old is not null").select(F.col("l_partkey").alias("partkey"), "month", F.col("old").alias("old_set"), F.col("new").alias("new_set"))


@R.add("""SELECT strftime(l_shipdate, '%Y-%m') AS month, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A')::bigint::varchar, '−') AS a, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N')::bigint::varchar, '−') AS n,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'R')::bigint::varchar, '−') AS r FROM lineitem GROUP BY 1""")
def variant_history_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.select("month", *(F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit("−")).alias(c.lower()) for c in ("A", "N", "R")))


_GRID = f"""WITH days AS (SELECT chain, run_date, bool_or(ok) AS ok FROM snapshot_runs GROUP BY ALL),
    seen AS (SELECT DISTINCT s.chain, {plain_sql("product_id")} AS pid, s.run_date FROM product_snapshots s JOIN days USING (chain, run_date) WHERE product_id IS NOT NULL),
    keys AS (SELECT chain, pid, min(run_date) AS born FROM seen GROUP BY ALL),
    grid AS (SELECT k.chain, k.pid, d.run_date, d.ok, s.run_date IS NOT NULL AS seen FROM keys k JOIN days d ON d.chain = k.chain AND d.run_date >= born LEFT JOIN seen s ON s.chain = k.chain AND s.pid = k.pid AND s.run_date = d.run_date),
    isl AS (SELECT *, sum(seen::int) OVER (PARTITION BY chain, pid ORDER BY run_date) AS island FROM grid),
    miss AS (SELECT *, sum((ok AND NOT seen)::int) OVER (PARTITION BY chain, pid, island ORDER BY run_date) AS misses FROM isl),
    per AS (SELECT chain, pid, island, min(run_date) AS sighted, max(misses) AS m, min(run_date) FILTER (misses = 2) AS ended FROM miss GROUP BY ALL),
    ep AS (SELECT *, coalesce(sum((m >= 2)::int) OVER (PARTITION BY chain, pid ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS episode FROM per),
    epi AS (SELECT chain, pid, episode, min(sighted) AS started, max(sighted) AS last_seen, least(arg_max(m, island), 2) AS missed, max(ended) AS ended FROM ep GROUP BY ALL)"""


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    days = lifecycle.complete_days(table(spark, d, "snapshot_runs"))
    seen = table(spark, d, "product_snapshots").where("product_id is not null").select("chain", plain_form(F.col("product_id")).alias("product_id"), "run_date")
    return lifecycle.episodes(seen, days)


@R.add(_GRID + " SELECT chain, pid AS product_id, episode::int AS episode, started::varchar AS started, last_seen::varchar AS last_seen, missed::int AS missed, ended::varchar AS ended FROM epi")
def lifecycle_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d).withColumns({c: F.col(c).cast("string") for c in ("started", "last_seen", "ended")})


@R.add(_GRID + """ SELECT chain, pid AS product_id, CASE WHEN arg_max(ended, episode) IS NULL OR arg_max(missed, episode) < 2 THEN 'on_sale' ELSE 'ended' END AS status, arg_max(missed, episode)::int AS missed,
    min(started)::varchar AS first_seen, max(last_seen)::varchar AS last_seen, (max(episode) - 1)::int AS relaunches FROM epi GROUP BY ALL""")
def lifecycle_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.state(_episodes(spark, d)).select("chain", "product_id", "status", "missed", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "relaunches")


@R.add("SELECT chain, run_date::varchar AS run_date, bool_and(coalesce(ok, false)) AS ok, count(*) AS deliveries FROM snapshot_runs GROUP BY ALL")
def completeness_gate(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "snapshot_runs")
    counted = runs.groupBy("chain", "run_date").agg(F.count(F.lit(1)).alias("deliveries"))
    return lifecycle.complete_days(runs, every=True).join(counted, ["chain", "run_date"]).select("chain", F.col("run_date").cast("string").alias("run_date"), "ok", "deliveries")


@R.add("""WITH d AS (SELECT user_id, ts::date AS day FROM events WHERE event_type = 'error' GROUP BY ALL), g AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::int AS grp FROM d)
    SELECT user_id, min(day)::varchar AS started, max(day)::varchar AS ended, count(*) AS length FROM g GROUP BY user_id, grp""")
def problem_streaks(spark: SparkSession, d: str) -> DataFrame:
    found = lifecycle.streaks(table(spark, d, "events").withColumn("bad", F.col("event_type") == "error"), keys=["user_id"], date="ts", bad="bad")
    return found.select("user_id", F.col("started").cast("string").alias("started"), F.col("ended").cast("string").alias("ended"), "length")


@R.add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY run_date, run_seq) AS n FROM snapshot_runs), g AS (SELECT *, n - row_number() OVER (PARTITION BY chain ORDER BY n) AS grp FROM r WHERE coalesce(http_status, 0) <> 200)
    SELECT chain, min(n) AS first, max(n) AS last, count(*) AS length FROM g GROUP BY chain, grp""")
def block_streaks(spark: SparkSession, d: str) -> DataFrame:
    found = lifecycle.run_streaks(table(spark, d, "snapshot_runs"), keys=["chain"], order=["run_date", "run_seq"], bad=F.coalesce("http_status", F.lit(0)) != 200, least=1)
    return found.select("chain", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "length")


_HOLD = f"""WITH {_LISTED}, born AS (SELECT chain, pid, min(run_date) AS born FROM listed GROUP BY ALL),
    c AS (SELECT l.chain, l.run_date, count(*) AS total, count(*) FILTER (born = l.run_date) AS fresh FROM listed l JOIN born USING (chain, pid) GROUP BY ALL)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    seen = listed(spark, d).select("chain", "run_date", "pid")
    born = seen.withColumn("born", F.min("run_date").over(Window.partitionBy("chain", "pid")))
    return born.groupBy("chain", "run_date").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("born") == F.col("run_date")).alias("fresh"))


@R.add(_HOLD + """, j AS (SELECT *, greatest(4, floor(total * 0.08)::int) AS lim, row_number() OVER (PARTITION BY chain ORDER BY run_date) AS n FROM c), h AS (SELECT *, fresh > lim AND n > 1 AS held FROM j),
    g AS (SELECT *, sum((NOT held)::int) OVER (PARTITION BY chain ORDER BY run_date) AS grp FROM h)
    SELECT chain, run_date::varchar AS run_date, total, fresh, held, (CASE WHEN held THEN sum(held::int) OVER (PARTITION BY chain, grp ORDER BY run_date) ELSE 0 END)::int AS hold_days FROM g""")
def hold_runs(spark: SparkSession, d: str) -> DataFrame:
    found = lifecycle.holds(_counts(spark, d), keys=["chain"], date="run_date", total="total", unknown="fresh", floor=4, share=0.08)
    return found.select("chain", F.col("run_date").cast("string").alias("run_date"), "total", "fresh", "held", "hold_days")


@R.add(_HOLD + """, j AS (SELECT *, lag(total) OVER (PARTITION BY chain ORDER BY run_date) AS previous FROM c) SELECT chain, run_date::varchar AS run_date, total, previous, coalesce(total >= previous * 0.95, true) AS ok FROM j""")
def ratio_guard(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.ratio_guard(_counts(spark, d), keys=["chain"], date="run_date", n="total", ratio=0.95).withColumn("run_date", F.col("run_date").cast("string"))


@R.add("""WITH o AS (SELECT o_custkey AS k, o_orderdate::date AS day, min(o_orderpriority) AS v FROM orders GROUP BY ALL), x AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY day) AS old FROM o)
    SELECT k AS custkey, day::varchar AS day, old AS old_category, v AS new_category FROM x WHERE old <> v""")
def category_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("day")).agg(F.min("o_orderpriority").alias("v"))
    found = lifecycle.changes(rows, keys=["custkey"], at="day", value="v").where("old is not null")
    return found.select("custkey", F.col("day").cast("string").alias("day"), F.col("old").alias("old_category"), F.col("new").alias("new_category"))


@R.add(f"""WITH {_LISTED}, f AS (SELECT chain, min(run_date) AS f FROM listed GROUP BY chain), b AS (SELECT l.chain, pid FROM listed l JOIN f ON f.chain = l.chain AND l.run_date = f)
    SELECT DISTINCT chain, pid AS product_id FROM listed l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chain = l.chain AND b.pid = l.pid)""")
def new_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d).select("chain", "run_date", F.col("pid").alias("product_id"))
    first = rows.groupBy("chain").agg(F.min("run_date").alias("run_date"))
    return merge.new_against(rows, rows.join(first, ["chain", "run_date"]), scope=["chain"], key="product_id").select("chain", "product_id").distinct()


@R.add(f"""WITH {_LISTED} SELECT chain, run_date::varchar AS run_date, count(*) AS known FROM listed l WHERE EXISTS (SELECT 1 FROM products p WHERE p.chain = l.chain AND p.product_id = l.pid) GROUP BY ALL""")
def known_only(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "products").select("chain", F.col("product_id").alias("pid"))
    return listed(spark, d).join(stored, ["chain", "pid"], "left_semi").groupBy("chain", F.col("run_date").cast("string").alias("run_date")).agg(F.count(F.lit(1)).alias("known"))


@R.add(f"""WITH {_LISTED}, last AS (SELECT chain, max(run_date) AS run_date FROM listed GROUP BY chain), t AS (SELECT l.* FROM listed l JOIN last USING (chain, run_date)),
    s AS (SELECT chain, product_id, price FROM products WHERE chain IN (SELECT chain FROM last))
    SELECT coalesce(s.chain, t.chain) AS chain, coalesce(s.product_id, t.pid) AS product_id, coalesce(t.price, s.price) AS price,
    CASE WHEN s.product_id IS NULL THEN 'insert' WHEN t.pid IS NULL THEN 'missing' ELSE 'update' END AS action FROM s FULL JOIN t ON s.chain = t.chain AND s.product_id = t.pid""")
def upsert_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    last = rows.groupBy("chain").agg(F.max("run_date").alias("run_date"))
    today = rows.join(last, ["chain", "run_date"]).select("chain", F.col("pid").alias("product_id"), "price")
    stored = table(spark, d, "products").select("chain", "product_id", "price").join(last, "chain", "left_semi")
    return merge.upsert(stored, today, keys=["chain", "product_id"], update={"price": F.coalesce("t.price", "s.price")})


@R.add(f"""WITH {_LISTED}, f AS (SELECT chain, min(run_date) AS f FROM listed GROUP BY chain), b AS (SELECT l.chain, pid FROM listed l JOIN f ON f.chain = l.chain AND l.run_date = f)
    SELECT l.chain, CASE WHEN coalesce(limited, false) OR len(coalesce(badges, [])) > 0 THEN 'limited' WHEN b.pid IS NULL THEN 'new' ELSE 'regular' END AS kind, count(*) AS n
    FROM listed l LEFT JOIN b ON b.chain = l.chain AND b.pid = l.pid GROUP BY ALL""")
def classify_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    first = rows.groupBy("chain").agg(F.min("run_date").alias("run_date"))
    base = rows.join(first, ["chain", "run_date"]).select("chain", "pid", F.lit(False).alias("fresh"))
    kind = merge.classify(F.col("limited"), F.size(F.coalesce("badges", F.array().cast("array<string>"))) > 0, F.lit(False), F.coalesce("fresh", F.lit(True)))
    return rows.join(base, ["chain", "pid"], "left").groupBy("chain", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH x AS (SELECT chain, run_date, {plain_sql("product_id")} AS product_id, * EXCLUDE (chain, run_date, product_id) FROM product_snapshots WHERE product_id IS NOT NULL)
    SELECT chain, run_date::varchar AS run_date, product_id, bool_or(coalesce(limited, false)) AS limited, bool_or(coalesce(is_new, false)) AS is_new,
    arg_min(category, (page_ord * 100000 + card_ord) * 100 + run_seq) FILTER (category IS NOT NULL) AS category, array_to_string(list_sort(list_distinct(flatten(list(coalesce(badges, []))))), ',') AS badges FROM x GROUP BY ALL""")
def pages_merged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "product_snapshots").where("product_id is not null").withColumn("product_id", plain_form(F.col("product_id")))
    found = merge.merge_pages(rows, keys=["chain", "run_date", "product_id"], order=["page_ord", "card_ord", "run_seq"], flags=["limited", "is_new"], firsts=["category"], sets=["badges"])
    return found.withColumns({"badges": F.array_join("badges", ","), "run_date": F.col("run_date").cast("string")})


@R.add("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY last_seen_at NULLS FIRST, product_id) AS rank FROM products WHERE status = 'on_sale') SELECT chain, product_id, rank FROM r WHERE rank <= 20""")
def recheck_queue(spark: SparkSession, d: str) -> DataFrame:
    return merge.top_by(table(spark, d, "products").where("status = 'on_sale'"), scope=["chain"], order=[F.asc_nulls_first("last_seen_at"), "product_id"], limit=20).select("chain", "product_id", "rank")


@R.add(_HOLD + """ SELECT chain, run_date::varchar AS run_date, least(fresh, 3) AS created, greatest(fresh - 3, 0) AS deferred FROM c""")
def creation_budget(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    seen = listed(spark, d).withColumn("born", F.min("run_date").over(Window.partitionBy("chain", "pid")))
    fresh = seen.where("born = run_date")
    ranked = merge.budget(fresh, scope=["chain", "run_date"], order=["pid"], limit=3).groupBy("chain", "run_date").agg(F.count_if("within").alias("created"), F.count_if(~F.col("within")).alias("deferred"))
    days = seen.select("chain", "run_date").distinct()
    return days.join(ranked, ["chain", "run_date"], "left").select("chain", F.col("run_date").cast("string").alias("run_date"), F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("deferred", F.lit(0)).alias("deferred"))


@R.add("""WITH a AS (SELECT c_nationkey AS k, c_custkey AS id FROM customer WHERE c_acctbal < -500), b AS (SELECT s_nationkey AS k, s_suppkey AS id FROM supplier WHERE s_acctbal > 9000)
    SELECT k AS nationkey, min(a.id) AS old, (SELECT min(b.id) FROM b WHERE b.k = a.k) AS new FROM a GROUP BY k HAVING count(*) = 1 AND (SELECT count(*) FROM b WHERE b.k = a.k) = 1""")
def mutual_unique_rekey(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_acctbal < -500").select(F.col("c_nationkey").alias("nationkey"), F.col("c_custkey").alias("id"))
    fresh = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey"), F.col("s_suppkey").alias("id"))
    return merge.mutual_moves(gone, fresh, by=["nationkey"], key="id")


@R.add("""SELECT p_brand AS brand, p_name AS name, count(*) AS merged, arg_min(p_type, p_partkey) AS type, arg_max(p_size, p_partkey) AS size, max(p_retailprice) AS price FROM part GROUP BY ALL""")
def merge_rekeyed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_partkey").alias("born"), F.col("p_partkey").alias("seen"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    found = merge.merge_rekeyed(rows, keys=["brand", "name"], born="born", seen="seen", oldest=["type"], newest=["size"])
    best = rows.groupBy("brand", "name").agg(F.max("price").alias("price"))
    return found.join(best, ["brand", "name"]).select("brand", "name", "merged", "type", "size", "price")


@R.add("""WITH n AS (SELECT c_custkey AS id, 'new' AS origin FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT c_custkey AS id, 'old' AS origin FROM customer WHERE c_acctbal > 0)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def override_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return merge.override(c.where("c_acctbal > 0").select("id", F.lit("old").alias("origin")), c.where("c_mktsegment = 'BUILDING'").select("id", F.lit("new").alias("origin")), keys=["id"])


@R.add("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders EXCEPT SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'N' AND l_shipdate > timestamp '1996-01-01'")
def stale_except(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    want = table(spark, d, "lineitem").where("l_returnflag = 'N' and l_shipdate > '1996-01-01'").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return have.distinct().subtract(want)


@R.add("""SELECT p_brand AS brand, array_to_string(list_sort(list_distinct(list_concat(list_distinct(list(p_type)), list_distinct(list(p_name))))), ',') AS sources FROM part GROUP BY ALL""")
def list_union(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("a"), F.collect_set("p_name").alias("b"))
    return by.select("brand", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("sources"))


@R.add("""WITH x AS (SELECT chain, list_distinct(flatten(list(coalesce(badges, [])))) AS b FROM product_snapshots GROUP BY chain)
    SELECT chain, array_to_string(list_filter(['期間限定', '数量限定', '新商品', '人気', '限定'], lambda v: list_contains(b, v)), ',') AS badges FROM x""")
def badge_union(spark: SparkSession, d: str) -> DataFrame:
    by = merge.merge_pages(table(spark, d, "product_snapshots"), keys=["chain"], order=["run_date"], sets=["badges"])
    order = F.array(*(F.lit(x) for x in ("期間限定", "数量限定", "新商品", "人気", "限定")))
    return by.select("chain", F.array_join(F.filter(order, lambda v: F.array_contains("badges", v)), ",").alias("badges"))


@R.add("""WITH f AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'error' GROUP BY ALL), ok AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT f.user_id FROM f LEFT JOIN ok USING (user_id) WHERE ok.at IS NULL OR ok.at < f.at""")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    failed = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("at"))
    good = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ok_at"))
    done = failed.join(good, "user_id").where("ok_at >= at").select("user_id")
    return merge.dead_letters(failed.limit(0), failed, done, keys=["user_id"]).select("user_id")


@R.add("""WITH s AS (SELECT c_custkey AS id, c_nationkey % 3 AS v, c_acctbal AS val FROM customer WHERE c_acctbal > 0), o AS (SELECT c_custkey AS id, c_nationkey % 2 AS v, -c_acctbal AS val FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
    SELECT coalesce(s.id, o.id) AS id, CASE WHEN o.id IS NOT NULL AND o.v IS DISTINCT FROM s.v THEN o.v ELSE s.v END AS v, CASE WHEN o.id IS NOT NULL AND o.v IS DISTINCT FROM s.v THEN o.val ELSE s.val END AS val,
    CASE WHEN s.id IS NULL THEN 'insert' WHEN o.id IS NOT NULL AND o.v IS DISTINCT FROM s.v THEN 'replace' ELSE 'keep' END AS action FROM s FULL JOIN o ON s.id = o.id""")
def version_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stored = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("v"), F.col("c_acctbal").alias("val"))
    offered = c.where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).alias("v"), (-F.col("c_acctbal")).alias("val"))
    return gates.version_upsert(stored, offered, key="id", version="v", values=["val"])


@R.add("""WITH s AS (SELECT chain AS id, max(delivered_at) FILTER (ok) AS at, arg_max(http_status, (run_date, run_seq)) AS sig FROM snapshot_runs GROUP BY 1)
    SELECT id, CASE WHEN sig = 200 THEN 'changed' END AS reason FROM s WHERE sig = 200""")
def source_changes(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "snapshot_runs").groupBy(F.col("chain").alias("id")).agg(F.max_by("http_status", F.struct("run_date", "run_seq")).alias("sig"))
    state = runs.select("id", F.lit(0).alias("sig"), F.lit(None).cast("date").alias("checked"), F.when(F.col("sig") != 200, F.col("sig")).alias("bad_signature"))
    return gates.sources_to_read(runs, state, key="id", signature="sig", checked="checked", today=F.to_date(F.lit("2026-11-01")))


@R.add("""WITH x AS (SELECT p_brand AS source, abs(p_size * 4 + (p_partkey % 40) * 9 + 100 - p_retailprice) <= greatest(p_retailprice * 0.6, 6.0) AS ok, p_size > 10 AS full_row FROM part),
    g AS (SELECT source, count(*) AS n, round(avg(ok::int), 6) AS pass_rate, round(avg(full_row::int), 6) AS completeness FROM x GROUP BY ALL)
    SELECT source, n, pass_rate, completeness, CASE WHEN n < 80 THEN 'few_rows' WHEN pass_rate < 0.8 THEN 'pass_rate' WHEN completeness < 0.8 THEN 'completeness' END AS reason FROM g""")
def source_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ok = gates.energy_ok(F.col("p_size"), F.col("p_partkey") % 40, F.lit(25), F.col("p_retailprice"), share=0.6)
    return gates.source_gate(p.withColumnRenamed("p_brand", "source"), keys=["source"], ok=ok, complete=F.col("p_size") > 10)
