"""Queries of the training-data problems over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menuflow.llm import encode, language, name_mapping, packing, survivors, visual_text
from menuflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records, bundles = survivors.product_bundles(table(spark, d, "products"), table(spark, d, "source_trust"))
    return survivors.choose_bundles(records, table(spark, d, "duplicate_members"), bundles).select("group_id", F.col("bundle").alias("field"), "record_id")


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Survivors under a dependency: with the name comes its category's product, and its address has to be one of that product_id."""
    records, bundles = survivors.product_bundles(table(spark, d, "products"), table(spark, d, "source_trust"))
    named = survivors.Bundle("identity", F.col("product_id").isNotNull() & F.col("name").isNotNull(), [F.col("_trust"), F.unix_date("last_seen_at")], ("product_id", "name", "category"), weight=1)
    depends = [survivors.Dependency(("identity", "product_id"), ("official_url", "official_url"))]
    chosen = survivors.choose_bundles(records, table(spark, d, "duplicate_members"), [named, *bundles], depends)
    return chosen.select("group_id", F.col("bundle").alias("field"), "record_id")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return name_mapping.map_names(table(spark, d, "name_entries"), table(spark, d, "menu_reference"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("entry_id", "ref_id")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Names that mean no listed item, with how many entries have them."""
    none = _mapped(spark, d).where("ref_id = -1").select("entry_id")
    entries = table(spark, d, "name_entries").select("entry_id", "chain", "name").distinct()
    return entries.join(none, "entry_id", "left_semi").groupBy("chain", "name").agg(F.count(F.lit(1)).alias("entries"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = visual_text.look_same(table(spark, d, "products"))
    return pairs.select(F.col("record_id_a").alias("record_a"), F.col("record_id_b").alias("record_b"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every product name."""
    return table(spark, d, "products").select("record_id", visual_text.canonical_text(F.col("name")).alias("form"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p8_sharing(spark: SparkSession, d: str) -> DataFrame:
    """How much of the corpus is encoded once for several places: pieces, distinct pieces and their ids."""
    cut = encode.encoded_pieces(table(spark, d, "documents"))
    return cut.groupBy(F.size("ids").alias("tokens")).agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("ids").alias("distinct_pieces"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, d, "documents"))
    return packing.pack(sizes, table(spark, d, "pack_limits").select("limit_id", F.col("capacity_tokens").alias("capacity")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("limit_id", "container", "doc_id", "piece", "start", F.col("size").alias("n_tokens"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers used, the fewest possible by volume, and the share of space used."""
    by = _packed(spark, d).groupBy("limit_id", "capacity").agg(F.countDistinct("container").alias("containers"), F.sum("size").alias("n_tokens"))
    return by.select("limit_id", "capacity", "containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("fewest"), "n_tokens", F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity")), 4).alias("used"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.identify(documents, language.fit_profiles(documents))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.corrections(_languages(spark, d)).select("doc_id", "paragraph", "lang")


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document with words, with its confidence."""
    return _languages(spark, d).where("paragraph = 0").select("doc_id", "lang", "confidence", "mixed")


QUERIES: dict[str, Query] = {
    "p4_found": p4_found,
    "p4_consistent": p4_consistent,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p7_found": p7_found,
    "p7_forms": p7_forms,
    "p8_ids": p8_ids,
    "p8_sharing": p8_sharing,
    "p9_containers": p9_containers,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_documents": p10_documents,
}
_DAY = r"regexp_replace(regexp_replace(trim(launch_date), '^(\d{4})(\d{2})(\d{2})$', '\1-\2-\3'), '^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$', '\1-\2-\3')"

_URL = r"""regexp_matches(trim(official_url), '^https?://[^/?#\s]+/[^?#\s]*[^/?#\s]', 'i')"""
_MEMBERS = rf"""m AS (SELECT DISTINCT group_id, record_id FROM duplicate_members),
        p AS (SELECT m.group_id, p.*, coalesce(t.trust, -1) AS trust, coalesce(last_seen_at, date '0001-01-01') AS seen,
                     len(list_filter(coalesce(price_history, []), lambda e: e.date IS NOT NULL AND e.price > 0)) AS good,
                     try_cast(CASE WHEN regexp_full_match({_DAY}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}') THEN {_DAY} END AS date) AS day
              FROM m JOIN products p USING (record_id) LEFT JOIN source_trust t ON t.source = p.source)"""
_RANKED = rf"""r AS (
            SELECT group_id, 'first_seen_at' AS field, record_id, row_number() OVER (PARTITION BY group_id ORDER BY first_seen_at, record_id) AS n
            FROM p WHERE first_seen_at >= timestamp '2015-01-01' AND (last_seen_at IS NULL OR first_seen_at::date <= last_seen_at)
            UNION ALL
            SELECT group_id, 'launch_date', record_id, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, seen DESC, record_id) FROM p WHERE year(day) BETWEEN 2015 AND 2026
            UNION ALL
            SELECT group_id, 'official_url', record_id, row_number() OVER (PARTITION BY group_id ORDER BY trust DESC, seen DESC, record_id)
            FROM p WHERE regexp_matches(trim(official_url), '^https?://[^/?#\s]+/[^?#\s]*[^/?#\s]', 'i')
            UNION ALL
            SELECT group_id, 'price_history', record_id, row_number() OVER (PARTITION BY group_id ORDER BY good DESC, trust DESC, seen DESC, record_id) FROM p WHERE good > 0)"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": f"WITH {_MEMBERS}, {_RANKED} SELECT group_id, field, record_id FROM r WHERE n = 1",
    # every pair of an identity and an address is tried, with none for either: as many as possible, then their trusts, then their ranks
    "p4_consistent": f"""WITH {_MEMBERS}, {_RANKED},
        beside AS (SELECT DISTINCT group_id, product_id, official_url FROM p WHERE product_id IS NOT NULL AND official_url IS NOT NULL),
        i AS (SELECT group_id, record_id, product_id, trust, seen FROM p WHERE product_id IS NOT NULL AND name IS NOT NULL UNION ALL SELECT DISTINCT group_id, NULL, NULL, NULL, NULL FROM p),
        u AS (SELECT group_id, record_id, official_url, trust, seen FROM p WHERE {_URL} UNION ALL SELECT DISTINCT group_id, NULL, NULL, NULL, NULL FROM p),
        x AS (SELECT i.group_id, i.record_id AS a, u.record_id AS b, row_number() OVER (PARTITION BY i.group_id ORDER BY (i.record_id IS NOT NULL)::int + (u.record_id IS NOT NULL)::int DESC, greatest(coalesce(i.trust, 0), 0) + greatest(coalesce(u.trust, 0), 0) DESC,
                     i.trust DESC NULLS LAST, i.seen DESC NULLS LAST, i.record_id NULLS LAST, u.trust DESC NULLS LAST, u.seen DESC NULLS LAST, u.record_id NULLS LAST) AS n
              FROM i JOIN u USING (group_id)
              WHERE i.record_id IS NULL OR u.record_id IS NULL OR EXISTS (SELECT 1 FROM beside s WHERE s.group_id = i.group_id AND s.product_id = i.product_id AND s.official_url = u.official_url)
                    OR NOT EXISTS (SELECT 1 FROM beside s WHERE s.group_id = i.group_id AND s.product_id = i.product_id))
        SELECT group_id, field, record_id FROM r WHERE n = 1 AND field <> 'official_url' UNION ALL SELECT group_id, 'identity', a FROM x WHERE n = 1 AND a IS NOT NULL UNION ALL SELECT group_id, 'official_url', b FROM x WHERE n = 1 AND b IS NOT NULL""",
}
