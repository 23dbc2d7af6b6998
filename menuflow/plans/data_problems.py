"""Queries of the general data problems: snapshots, histories, nested records, units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.operators import attribute_history, shred, snapshot_diff, units
from menuflow.plans.observation import plain_sql
from menuflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.diff_snapshots(table(spark, d, "product_snapshots"), table(spark, d, "snapshot_runs")).withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d).select("chain", "product_id", "run_date", "change")


def p1_changed_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each set of fields changed, per chain."""
    return _diff(spark, d).groupBy("chain", "change", "fields").agg(F.count(F.lit(1)).alias("n"), F.min("run_date").alias("first_date"), F.max("run_date").alias("last_date"))


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    store = attribute_history.build_history(table(spark, d, "product_updates"))
    return attribute_history.versions(store).select(
        "chain", "product_id", _stamp("valid_from").alias("valid_from"), F.coalesce(_stamp("valid_to"), F.lit("")).alias("valid_to"), F.col("price").cast("bigint").alias("price"), "status"
    )


def p2_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Price and status of every product at one moment."""
    store = attribute_history.build_history(table(spark, d, "product_updates"))
    return attribute_history.as_of(store, "2026-03-01 00:00:00").select("chain", "product_id", F.col("price").cast("bigint").alias("price"), "status")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return shred.product_children(table(spark, d, "raw_records")).select("record_id", "child", "pos", "name").distinct()


def p3_node_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency table of all latest bodies, counted by path and kind."""
    nodes = shred.shred(shred.latest_fetch(table(spark, d, "raw_records")))
    return nodes.groupBy(F.regexp_replace("path", r"\.other\..*$", ".other.*").alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(table(spark, d, "nutrition_lines")).select("line_id", "nutrient", "amount")


def p6_notations(spark: SparkSession, d: str) -> DataFrame:
    """What each notation was taken for, by what, with the estimate and its standard error."""
    return units.conversions(units.parse_lines(table(spark, d, "nutrition_lines"))).select(
        "dimension", "notation", "support", "links", F.round("estimated", 6).alias("estimated"), F.round("error", 4).alias("error"), F.round("offset", 3).alias("offset"), "unit", "factor", "decided", "agrees"
    )


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_changed_fields": p1_changed_fields,
    "p2_found": p2_found,
    "p2_as_of": p2_as_of,
    "p3_found": p3_found,
    "p3_node_kinds": p3_node_kinds,
    "p6_found": p6_found,
    "p6_notations": p6_notations,
}


_SNAPSHOTS = f"""runs AS (SELECT chain, run_date, max(run_seq) AS run_seq FROM snapshot_runs WHERE ok GROUP BY ALL),
    r AS (SELECT *, lag(run_date) OVER (PARTITION BY chain ORDER BY run_date) AS prev FROM runs),
    l AS (SELECT DISTINCT ON (s.chain, s.run_date, pid) s.chain, s.run_date, {plain_sql("product_id")} AS pid, price, {plain_sql("status")} AS status
          FROM product_snapshots s JOIN runs USING (chain, run_date, run_seq) WHERE product_id IS NOT NULL ORDER BY s.chain, s.run_date, pid, page_ord, card_ord),
    now AS (SELECT r.chain, r.run_date, l.pid, l.price, l.status FROM r JOIN l ON l.chain = r.chain AND l.run_date = r.run_date WHERE prev IS NOT NULL),
    old AS (SELECT r.chain, r.run_date, l.pid, l.price, l.status FROM r JOIN l ON l.chain = r.chain AND l.run_date = r.prev),
    diff AS (SELECT coalesce(n.chain, o.chain) AS chain, coalesce(n.pid, o.pid) AS product_id, strftime(coalesce(n.run_date, o.run_date), '%Y-%m-%d') AS run_date,
                    CASE WHEN o.pid IS NULL THEN 'added' WHEN n.pid IS NULL THEN 'removed' ELSE 'changed' END AS change,
                    CASE WHEN o.pid IS NULL OR n.pid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.price IS DISTINCT FROM o.price THEN 'price' END, CASE WHEN n.status IS DISTINCT FROM o.status THEN 'status' END) END AS fields
             FROM now n FULL JOIN old o ON n.chain = o.chain AND n.run_date = o.run_date AND n.pid = o.pid
             WHERE o.pid IS NULL OR n.pid IS NULL OR n.price IS DISTINCT FROM o.price OR n.status IS DISTINCT FROM o.status)"""
_HISTORY = f"""u AS (SELECT DISTINCT ON (chain, pid, observed_at) chain, {plain_sql("product_id")} AS pid, observed_at, price, {plain_sql("status")} AS status FROM product_updates
          WHERE product_id IS NOT NULL AND observed_at IS NOT NULL ORDER BY chain, pid, observed_at, received_at DESC, update_id DESC),
    k AS (SELECT chain, pid, observed_at, last_value(price IGNORE NULLS) OVER w AS price, last_value(status IGNORE NULLS) OVER w AS status FROM u WINDOW w AS (PARTITION BY chain, pid ORDER BY observed_at)),
    c AS (SELECT *, lag(price) OVER w AS p0, lag(status) OVER w AS s0 FROM k WINDOW w AS (PARTITION BY chain, pid ORDER BY observed_at)),
    v AS (SELECT *, lead(observed_at) OVER (PARTITION BY chain, pid ORDER BY observed_at) AS until FROM c WHERE price IS DISTINCT FROM p0 OR status IS DISTINCT FROM s0)"""


def _embedded(x: str) -> str:
    return rf"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '^\s*[\[{{]') AND json_valid({x}->>'$') THEN ({x}->>'$')::json ELSE {x} END"


def _list(x: str) -> str:
    """The elements of an array, or a lone value as the only one."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def _name(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN {x}->>'$' WHEN 'NULL' THEN '' WHEN 'OBJECT' THEN '' WHEN 'ARRAY' THEN '' ELSE coalesce({x}::varchar, '') END"


def _member(x: str, label: str) -> str:
    """The name of an element: its member ``label``, or itself where it isn't an object."""
    inner = f"json_extract({x}, '$.{label}')"
    return f"CASE WHEN json_type({x}) = 'OBJECT' THEN coalesce({_name(inner)}, '') ELSE {_name(x)} END"


_FETCHES = f"""f AS (SELECT record_id, body, row_number() OVER (PARTITION BY record_id ORDER BY fetched_at DESC NULLS LAST, body DESC NULLS LAST) AS n FROM raw_records WHERE record_id IS NOT NULL),
    j AS (SELECT record_id, body::json AS j FROM f WHERE n = 1 AND json_valid(body)), p AS (SELECT record_id, CASE WHEN json_type(j, '$.product') = 'OBJECT' THEN j->'product' ELSE j END AS p FROM j),
    a AS (SELECT record_id, {_embedded("(p->'nutrition_variants')")} AS v, {_embedded("(p->'allergens')")} AS al, {_embedded("(p->'price_history')")} AS h FROM p),
    v AS (SELECT record_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT record_id, {_list("v")} AS l FROM a)),
    c AS (SELECT record_id, 'contains' AS child, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT record_id, {_list("(al->'contains')")} AS l FROM a)
          UNION ALL SELECT record_id, 'partial', unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT record_id, {_list("(al->'partial')")} AS l FROM a)
          UNION ALL SELECT record_id, 'price', unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT record_id, {_list("h")} AS l FROM a)),
    o AS (SELECT record_id, pos, unnest(json_keys((e->'nutrition')->'other')) AS k FROM v WHERE json_type((e->'nutrition')->'other') = 'OBJECT'),
    z AS (SELECT record_id, pos, unnest(l) AS e FROM (SELECT record_id, pos, {_list("(e->'sizes')")} AS l FROM v WHERE json_type(e) = 'OBJECT'))"""
_CHILDREN = f"""SELECT record_id, 'variant' AS child, pos::int AS pos, {_member("e", "label")} AS name FROM v WHERE json_type(e) <> 'NULL'
    UNION SELECT record_id, 'variant_other', pos::int, k FROM o UNION SELECT record_id, 'variant_size', pos::int, {_member("e", "label")} FROM z WHERE json_type(e) <> 'NULL'
    UNION SELECT record_id, child, pos::int, CASE child WHEN 'price' THEN {_member("e", "date")} WHEN 'partial' THEN {_member("e", "name")} ELSE {_name("e")} END FROM c WHERE json_type(e) <> 'NULL'"""


def _folded(c: str) -> str:
    """Widths, squared signs and case folded, blanks removed, in SQL."""
    for odd, usual in (units.VOICED | units.SQUARED).items():
        c = f"replace({c}, '{odd}', '{usual}')"
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)).replace("'", "''")
    narrow = "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''")
    return rf"lower(regexp_replace(translate(translate({c}, '{wide}', '{narrow}'), '{units.HALF_KANA}', '{units.FULL_KANA}'), '[\s\p{{Z}}]+', '', 'g'))"


_NUMBER, _WORD = units.NUMBER, units.WORD
_NUTRIENT = " ".join(f"WHEN name IN ({', '.join(repr(x) for x in names)}) THEN '{key}'" for key, names in units.NUTRIENTS.items())
_FACTOR = " ".join(f"WHEN unit IN ({', '.join(repr(x) for x in units.NAMED[u])}) AND {'nutrient = ' if d == 'energy' else 'nutrient <> '}'kcal' THEN {f!r}" for d, us in units.KNOWN.items() for u, f in us.items())
_LINES = rf"""x AS (SELECT line_id, amount, {_folded("nutrient_label")} AS label, {_folded("amount_text")} AS text, nullif({_folded("unit")}, '') AS unit FROM nutrition_lines WHERE line_id IS NOT NULL),
    y AS (SELECT *, regexp_extract(label, '^([^(\[/:]+)', 1) AS name, nullif(regexp_extract(label, '[(\[/]({_WORD})[)\]]?$', 1), '') AS behind, coalesce(text, '') = '' AS silent,
          regexp_replace(regexp_replace(regexp_replace(text, '[(\[/*※].*$', ''), '^[^0-9<>≦≧≤≥〜~]*[:=]', ''), '^(?:約|およそ|推定|ほぼ|ca\.?|approx\.?)+|(?:前後|程度|くらい|ぐらい|ほど|弱|強)+$', '', 'g') AS main FROM x),
    z AS (SELECT line_id, CASE {_NUTRIENT} END AS nutrient, CASE WHEN silent THEN amount ELSE try_cast(nullif(replace(regexp_extract(main, '^({_NUMBER})({_WORD})?$', 1), ',', ''), '') AS double) END AS value,
          coalesce(CASE WHEN NOT silent THEN nullif(regexp_extract(main, '^({_NUMBER})({_WORD})?$', 2), '') END, unit, behind) AS unit FROM y),
    w AS (SELECT DISTINCT line_id, nutrient, value * CASE WHEN nutrient = 'sodium' THEN {units.SALT_PER_SODIUM} ELSE 1 END * CASE {_FACTOR} END AS exact FROM z WHERE nutrient IS NOT NULL AND value >= 0)"""


ORACLE_SQL: dict[str, str] = {
    "p3_found": f"WITH {_FETCHES} {_CHILDREN}",
    "p6_found": f"WITH {_LINES} SELECT DISTINCT line_id, CASE nutrient WHEN 'sodium' THEN 'salt_g' ELSE nutrient END AS nutrient, floor(round(exact, 6) + 0.5)::bigint AS amount FROM w WHERE exact IS NOT NULL",
    "p1_found": f"WITH {_SNAPSHOTS} SELECT chain, product_id, run_date, change FROM diff",
    "p1_changed_fields": f"WITH {_SNAPSHOTS} SELECT chain, change, fields, count(*) AS n, min(run_date) AS first_date, max(run_date) AS last_date FROM diff GROUP BY ALL",
    "p2_found": f"WITH {_HISTORY} SELECT chain, pid AS product_id, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), '') AS valid_to, price::bigint AS price, status FROM v",
    "p2_as_of": f"WITH {_HISTORY} SELECT chain, pid AS product_id, price::bigint AS price, status FROM v WHERE observed_at <= timestamp '2026-03-01' AND coalesce(until, timestamp '9999-01-01') > timestamp '2026-03-01'",
}
