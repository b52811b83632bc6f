"""Queries over sources, predicates, sorting and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.operators import filters as P
from ladle.operators import ranking as R
from ladle.operators import recommend as C
from ladle.plans.registry import AS_OF, as_of, query
from ladle.sources import tables as S
from ladle.sources.scratch import scratch_path



# --- sources and sinks -----------------------------------------------------------------------


@query("scan_table", "SELECT * FROM supplier")
def scan_table(t):
    return t.supplier


@query("scan_projected", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_projected(t):
    return t.orders.select("o_orderkey", "o_orderstatus")


@query("scan_limited", "SELECT recipe_id, title FROM recipes ORDER BY recipe_id LIMIT 100")
def scan_limited(t):
    return t.recipes.select("recipe_id", "title").orderBy("recipe_id").limit(100)


@query("read_url_list", "SELECT trim(url) AS url FROM pages WHERE trim(url) <> ''")
def read_url_list(t):
    return t.pages.select(F.trim("url").alias("url")).where(F.col("url") != "")


@query("read_raw_html", "SELECT page_id, url, length(html) AS n FROM pages")
def read_raw_html(t):
    return t.pages.select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("read_sitemap_xml", "SELECT DISTINCT url AS loc FROM pages")
def read_sitemap_xml(t):
    """Sitemaps of all pages, written and read again."""
    path = scratch_path(t.spark, "sitemap")
    S.write_sitemap(t.pages, path, 500)
    return S.read_sitemap(t.spark, path)


@query("read_json_docs", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def read_json_docs(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("load_dimension_if_absent", """
SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey
FROM nation)
""")
def load_dimension_if_absent(t):
    return S.insert_absent(t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["id"])


@query("resolve_hierarchy", """
SELECT n_nationkey, n_name, r_regionkey AS parent_id, r_name AS parent_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
""")
def resolve_hierarchy(t):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.col("r_regionkey").alias("parent_id"), F.col("r_name").alias("parent_name"))


@query("upsert_by_key", """
SELECT source_url, recipe_id FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY recipe_id DESC) r
FROM recipes) WHERE r = 1
""")
def upsert_by_key(t):
    r = t.recipes.select("source_url", "recipe_id")
    return S.upsert(r.where("recipe_id % 2 = 0"), r.where("recipe_id % 2 = 1"), ["source_url"], "recipe_id")


@query("partial_update", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'NEW'
ELSE c_mktsegment END AS c_mktsegment FROM customer
""")
def partial_update(t):
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"))
    return S.partial_update(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, "c_custkey")


@query("append_fact", "SELECT rec_id, user_id, recipe_id, CAST(recommended_at AS DATE) AS day FROM recommendations")
def append_fact(t):
    """What was shown, appended in two goes to a table by days, and read back."""
    path = scratch_path(t.spark, "shown")
    shown = t.recommendations.select("rec_id", "user_id", "recipe_id", F.to_date("recommended_at").alias("day"))
    for half in (0, 1):
        S.append_fact(shown.where(F.col("rec_id") % 2 == half), path, "day")
    return t.spark.read.schema(shown.schema).parquet(path)


@query("retention_delete", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def retention_delete(t):
    return S.retain(t.events.select("event_id", "ts"), "ts", as_of(), 14)


_DROPPED = "(SELECT recipe_id FROM (SELECT recipe_id, row_number() OVER (PARTITION BY source_url ORDER BY processed_at, recipe_id) r FROM recipes) WHERE r > 1)"


@query("cascade_delete", f"""
SELECT 'tags' AS name, count(*) AS n FROM tags WHERE recipe_id NOT IN {_DROPPED} UNION ALL SELECT 'ingredients', count(*)
FROM ingredients WHERE recipe_id NOT IN {_DROPPED} UNION ALL SELECT 'recipes', count(*) FROM recipes WHERE recipe_id NOT IN {_DROPPED}
""")
def cascade_delete(t):
    gone = R.duplicates_after_first(t.recipes, ["source_url"], ["processed_at", "recipe_id"]).select("recipe_id")
    left = S.cascade_delete(gone, {"tags": (t.tags, ["recipe_id"]), "ingredients": (t.ingredients, ["recipe_id"]), "recipes": (t.recipes, ["recipe_id"])})
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("mark_rows", """
SELECT page_id, CASE WHEN contains(url, 'spam') THEN 3 ELSE 0 END AS attempts, CASE WHEN contains(url, 'spam') THEN 'category page' END AS error
FROM pages
""")
def mark_rows(t):
    raw = t.pages.select("page_id", "url", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return S.mark(raw, F.col("url").contains("spam"), attempts=F.lit(3), error=F.lit("category page")).drop("url")


@query("backfill_default", "SELECT cook_id, coalesce(would_make_again, false) AS would_make_again FROM cooks")
def backfill_default(t):
    return t.cooks.select("cook_id", "would_make_again").na.fill(False)


@query("get_or_create", """
SELECT DISTINCT e.user_id, coalesce(p.diet, 'non_veg') AS diet, coalesce(p.heat, 3) AS heat
FROM events e LEFT JOIN profiles p ON p.user_id = e.user_id AND NOT p.is_dairy_free UNION SELECT user_id, diet, heat
FROM profiles WHERE NOT is_dairy_free
""")
def get_or_create(t):
    seen = t.events.select("user_id").distinct().withColumns({"diet": F.lit("non_veg"), "heat": F.lit(3)})
    return S.insert_absent(t.profiles.where("NOT is_dairy_free").select("user_id", "diet", "heat"), seen, ["user_id"])


@query("register_urls", """
SELECT count(*) FILTER (WHERE page_id % 4 <> 0) AS saved, count(*) FILTER (WHERE page_id % 4 = 0) AS skipped
FROM (SELECT url, min(page_id) FILTER (WHERE page_id % 4 = 0) IS NOT NULL AS old, CASE WHEN min(page_id) FILTER (WHERE page_id % 4 = 0) IS NOT NULL THEN 0
ELSE 1 END AS page_id FROM pages GROUP BY url)
""")
def register_urls(t):
    return P.register_urls(t.pages.select("url").distinct(), t.pages.where("page_id % 4 = 0").select("url").distinct()).agg(F.count_if("is_new").alias("saved"), F.count_if(~F.col("is_new")).alias("skipped"))


# --- predicates ------------------------------------------------------------------------------


@query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    return t.orders.where(F.col("o_orderstatus") == "F")


_BOUNDS = "SELECT recipe_id, total_time_minutes, s AS servings FROM (SELECT *, CASE WHEN recipe_id % 10 = 0 THEN NULL ELSE servings END AS s FROM recipes)"


def _nullable_servings(t) -> DataFrame:
    return t.recipes.select("recipe_id", "total_time_minutes", F.when(F.col("recipe_id") % 10 != 0, F.col("servings")).alias("servings"))


@query("filter_range", f"{_BOUNDS} WHERE total_time_minutes <= 60 AND s >= 2 AND s <= 5")
def filter_range(t):
    return _nullable_servings(t).where(P.in_range("total_time_minutes", most=60) & P.in_range("servings", 2, 5))


@query("filter_range_null_tolerant", f"{_BOUNDS} WHERE total_time_minutes <= 60 AND coalesce(s >= 2 AND s <= 5, true)")
def filter_range_null_tolerant(t):
    return _nullable_servings(t).where(P.in_range("total_time_minutes", most=60) & P.in_range("servings", 2, 5, null_passes=True))


@query("filter_in_list", "SELECT DISTINCT recipe_id FROM tags WHERE dimension = 'spice' AND tag_value IN ('spice_1', 'spice_2')")
def filter_in_list(t):
    return P.with_tag(t.tags.select("recipe_id").distinct(), t.tags, "spice", ["spice_1", "spice_2"])


@query("keyword_search", """
SELECT recipe_id, title, CAST(1 AS DOUBLE) AS score, count(*) OVER () AS total FROM recipes WHERE title ILIKE '%widget%' OR description ILIKE '%widget%'
ORDER BY recipe_id LIMIT 50 OFFSET 10
""")
def keyword_search(t):
    hits = t.recipes.where(P.keyword("widget", "title", "description"))
    return R.page(hits.select("recipe_id", "title", F.lit(1.0).alias("score")), ["recipe_id"], 10, 50, total=True)


@query("filter_creator_ilike", "SELECT recipe_id, c_name FROM recipes JOIN customer ON c_custkey = creator_id WHERE c_name ILIKE '%#00000001%'")
def filter_creator_ilike(t):
    return t.recipes.join(t.customer.where(F.col("c_name").ilike("%#00000001%")), F.col("creator_id") == F.col("c_custkey")).select("recipe_id", "c_name")


@query("exclude_keywords", "SELECT recipe_id FROM recipes WHERE title NOT ILIKE '%ring%' AND title NOT ILIKE '%bolt%' AND title NOT ILIKE '%large%'")
def exclude_keywords(t):
    return t.recipes.where(~P.any_keyword("title", ["ring", "bolt", "large"])).select("recipe_id")


@query("filter_like_null", "SELECT page_id FROM pages WHERE (nullif(html, '') IS NULL OR page_id % 3 = 0) AND contains(url, 'example.com')")
def filter_like_null(t):
    return t.pages.where((P.blank("html") | (F.col("page_id") % 3 == 0)) & F.col("url").contains("example.com")).select("page_id")


@query("json_key_exists", "SELECT event_id FROM events WHERE regexp_matches(props, '\"k\": *[0-9]')")
def json_key_exists(t):
    return t.events.where(P.json_has("props", "$.k")).select("event_id")


@query("json_path_all_null", "SELECT event_id, NOT regexp_matches(props, '\"k\": *[0-9]') AS is_category FROM events")
def json_path_all_null(t):
    return t.events.select("event_id", P.json_all_missing("props", ["$.k", "$.schema_org.name", "$.manual.title"]).alias("is_category"))


@query("classify_extraction", """
SELECT page_id, CASE WHEN contains(html, '<h1>') AND contains(html, '<li>') THEN 'complete_schema' WHEN contains(html, '<h1>') THEN 'incomplete_schema'
WHEN contains(html, '<li>') THEN 'recipe_scrapers' ELSE 'manual' END AS class FROM pages
""")
def classify_extraction(t):
    return t.pages.select("page_id", P.extraction_class(F.col("html").contains("<h1>"), F.col("html").contains("<li>"), F.col("html").contains("<li>")).alias("class"))


@query("filter_url_regex", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)/EN/[0-9]+')")
def filter_url_regex(t):
    return t.pages.where(F.col("url").rlike("(?i)/EN/[0-9]+")).select("page_id", "url")


@query("filter_url_include_exclude", """
SELECT page_id FROM pages WHERE (contains(lower(url), '/en/') OR contains(lower(url), '/fr/')) AND NOT contains(lower(url), 'page=') AND NOT contains(lower(url), 'spam')
""")
def filter_url_include_exclude(t):
    return t.pages.where(P.url_matches("url", ["/en/", "/fr/"], ["page=", "spam"])).select("page_id")


@query("classify_url_page", """
SELECT page_id, CASE WHEN contains(lower(url), '/category/') OR contains(lower(url), '?page=') OR contains(lower(url), 'page/') THEN 'category'
WHEN contains(lower(url), '.html') OR contains(lower(url), '/en/') THEN 'recipe' ELSE 'other' END AS kind
FROM pages
""")
def classify_url_page(t):
    return t.pages.select("page_id", P.page_kind("url", ["/category/", "?page=", "page/"], [".html", "/en/"]).alias("kind"))


@query("creator_from_url", """
SELECT page_id, CASE WHEN contains(url, 'spam') THEN 'Spam' WHEN contains(url, 'blog.') THEN 'Blog' WHEN contains(url, 'example.org') THEN 'Org'
ELSE 'Unknown' END AS creator FROM pages
""")
def creator_from_url(t):
    return t.pages.select("page_id", P.first_match("url", [("spam", "Spam"), ("blog.", "Blog"), ("example.org", "Org")], "Unknown").alias("creator"))


@query("detect_binary_html", """
SELECT page_id, CASE WHEN contains(substr(html, 1, 20), 'PNG') OR contains(substr(html, 1, 20), 'JFIF') OR contains(substr(html, 1, 20), 'GIF')
OR contains(substr(html, 1, 20), 'JPEG') THEN 'binary_image' WHEN NOT contains(html, '<h1>') THEN 'no_metadata' ELSE 'ok' END AS issue
FROM pages
""")
def detect_binary_html(t):
    return t.pages.select("page_id", P.html_issue("html", F.col("html").contains("<h1>")).alias("issue"))


@query("filter_non_latin_title", "SELECT recipe_id FROM recipes WHERE NOT regexp_matches(title, '[ऀ-ॿಀ-೿஀-௿ఀ-౿ഀ-ൿ]')")
def filter_non_latin_title(t):
    return t.recipes.where(~P.non_latin("title")).select("recipe_id")


_VEG = "chicken|mutton|lamb|fish|prawn|shrimp|egg|meat|beef|pork|keema|gosht|gear"


@query("hard_constraints", f"""
SELECT DISTINCT p.user_id, r.recipe_id FROM recommendations s JOIN profiles p ON p.user_id = s.user_id JOIN recipes r ON r.recipe_id = s.recipe_id
WHERE NOT (p.diet = 'pure_veg' AND regexp_matches(r.title, '{_VEG}')) AND NOT (p.allium_status <> 'both' AND regexp_matches(r.title, 'onion|garlic|pyaz|lehsun|lasun|blue'))
AND NOT coalesce(contains(r.title, p.prohibition), false) AND NOT (p.is_dairy_free AND regexp_matches(r.title, 'paneer|cheese|milk|cream|butter|ghee|curd|yogurt|dahi|malai|makhani|large'))
""")
def hard_constraints(t):
    titles = P.title_flags(t.recipes.select("recipe_id", "title"), meat=[*P.MEAT, "gear"], allium=[*P.ALLIUM, "blue"], dairy=[*P.DAIRY, "large"])
    profiles = t.profiles.withColumn("prohibitions", F.array_compact(F.array("prohibition")))
    shown = t.recommendations.select("user_id", "recipe_id").distinct()
    return P.passing_pairs(shown, profiles, titles).select("user_id", "recipe_id")


@query("validate_constraints", """
SELECT recipe_id, CASE WHEN contains(title, 'red') THEN 'diet' WHEN contains(title, 'blue') OR contains(lower(description), 'small') THEN 'prohibited'
WHEN servings < 2 THEN 'confidence' END AS rejection_reason FROM recipes
""")
def validate_constraints(t):
    return t.recipes.select("recipe_id", P.first_reason(diet=F.col("title").contains("red"), prohibited=F.col("title").contains("blue") | F.lower("description").contains("small"), confidence=F.col("servings") < 2).alias("rejection_reason"))


@query("filter_nutrition", "SELECT ingredient_id FROM nutrition WHERE protein_g >= 10 AND calories <= 400 AND carbs_g <= 45 ORDER BY ingredient_id LIMIT 200")
def filter_nutrition(t):
    return t.nutrition.where(P.in_range("protein_g", 10) & P.in_range("calories", most=400) & P.in_range("carbs_g", most=45)).select("ingredient_id").orderBy("ingredient_id").limit(200)


@query("filter_date_between", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def filter_date_between(t):
    return t.orders.where(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))).select("o_orderkey", "o_orderdate")


@query("filter_lookback", f"SELECT swipe_id FROM swipes WHERE swiped_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def filter_lookback(t):
    return S.retain(t.swipes, "swiped_at", as_of(), 7).select("swipe_id")


@query("retryable_rows", """
SELECT page_id FROM pages WHERE html <> '' AND page_id % 5 < 3 AND page_id NOT IN (SELECT recipe_id
FROM recipes WHERE recipe_id % 2 = 0)
""")
def retryable_rows(t):
    return P.retryable(t.pages.withColumn("attempts", F.col("page_id") % 5).withColumn("failed", F.lit(False)), t.recipes.where("recipe_id % 2 = 0").select(F.col("recipe_id").alias("page_id")), "page_id").select("page_id")


_ALLOWED = "(SELECT 'texture' AS d, unnest(['SMALL', 'LARGE', 'PROMO']) AS v UNION ALL SELECT 'spice', unnest(['spice_1', 'spice_2', 'spice_3']))"


def _allowed(t) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES ('texture', array('SMALL', 'LARGE', 'PROMO'), true), ('spice', array('spice_1', 'spice_2', 'spice_3'), false), ('region', CAST(NULL AS ARRAY<STRING>), true), ('meal', CAST(NULL AS ARRAY<STRING>), true) AS (dimension, allowed_values, is_required)")


@query("allowed_values_check", f"SELECT tag_id FROM tags WHERE dimension = 'region' OR (dimension, tag_value) IN {_ALLOWED}")
def allowed_values_check(t):
    return P.allowed_tags(t.tags.withColumn("values", F.array("tag_value")), _allowed(t)).select("tag_id")


@query("confidence_filter", "SELECT tag_id FROM tags WHERE confidence >= 0.95")
def confidence_filter(t):
    return t.tags.where(F.col("confidence") >= 0.95).select("tag_id")


@query("missing_required_dims", """
SELECT r.recipe_id, d.d AS dimension FROM recipes r CROSS JOIN (SELECT unnest(['texture', 'region', 'meal']) AS d) d LEFT JOIN (SELECT DISTINCT recipe_id, dimension
FROM tags) t ON t.recipe_id = r.recipe_id AND t.dimension = d.d WHERE t.recipe_id IS NULL
""")
def missing_required_dims(t):
    return P.missing_dimensions(t.recipes.select("recipe_id"), t.tags, _allowed(t).where("is_required").select("dimension"))


@query("flag_projection", """
SELECT user_id, list_filter([CASE WHEN diet = 'pure_veg' THEN 'vegetarian' END, CASE WHEN is_dairy_free THEN 'dairy_free' END, CASE WHEN allium_status = 'no_both' THEN 'jain' END], lambda x: x IS NOT NULL) AS restrictions
FROM profiles
""")
def flag_projection(t):
    return t.profiles.select("user_id", P.flag_names(vegetarian=F.col("diet") == "pure_veg", dairy_free=F.col("is_dairy_free"), jain=F.col("allium_status") == "no_both").alias("restrictions"))


@query("profile_flags_from_list", """
SELECT user_id, allium_status IN ('no_onion', 'no_both') AS no_onion, list_filter(['Brand#1', 'Brand#2', 'Brand#3'], lambda x: x <> region_1
AND x <> region_2) AS excluded FROM profiles
""")
def profile_flags_from_list(t):
    return t.profiles.select("user_id", F.array_contains(F.array(F.lit("no_onion"), F.lit("no_both")), F.col("allium_status")).alias("no_onion"), F.array_except(F.array(*map(F.lit, ["Brand#1", "Brand#2", "Brand#3"])), F.array("region_1", "region_2")).alias("excluded"))


@query("derive_profile", """
SELECT user_id, allium_status = 'no_both' AS is_jain, household = 'joint_family' AS multigenerational, CASE WHEN household = 'joint_family'
AND heat > 2 THEN heat - 1 ELSE heat END AS heat_adjusted, time_budget AS weekday_minutes FROM profiles
""")
def derive_profile(t):
    return t.profiles.select("user_id", (F.col("allium_status") == "no_both").alias("is_jain"), (F.col("household") == "joint_family").alias("multigenerational"), P.adjusted_heat("heat", F.col("household") == "joint_family").alias("heat_adjusted"), F.col("time_budget").alias("weekday_minutes"))


@query("map_list_values", """
SELECT user_id, list_sort(list_distinct([CASE WHEN region_1 IN ('Brand#1', 'Brand#2') THEN 'mustard' WHEN region_1 = 'Brand#3' THEN 'cumin'
ELSE 'other' END, CASE WHEN region_2 IN ('Brand#1', 'Brand#2') THEN 'mustard' WHEN region_2 = 'Brand#3' THEN 'cumin' ELSE 'other' END])) AS styles
FROM profiles
""")
def map_list_values(t):
    return t.profiles.select("user_id", P.mapped_values(F.array("region_1", "region_2"), {"Brand#1": ["mustard"], "Brand#2": ["mustard"], "Brand#3": ["cumin"]}, ["other"]).alias("styles"))


@query("vector_dim_check", "SELECT len(embedding) = 64 AS ok, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dim_check(t):
    return t.embeddings.groupBy((F.size("embedding") == 64).alias("ok")).agg(F.count("*").alias("n"))


@query("recipe_content_ratio", """
SELECT creator_id, round(avg(CASE WHEN regexp_matches(lower(concat(title, ' ', description)), 'ring|widget') THEN 1.0 ELSE 0.0 END), 6) AS ratio
FROM recipes GROUP BY 1
""")
def recipe_content_ratio(t):
    return t.recipes.groupBy("creator_id").agg(F.round(F.avg(P.any_keyword(F.concat_ws(" ", "title", "description"), ["ring", "widget"]).cast("double")), 6).alias("ratio"))


@query("filter_min_duration", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r
FROM events WHERE value > 10) WHERE r <= 20
""")
def filter_min_duration(t):
    return R.top_per(t.events.where("value > 10").select("user_id", "event_id"), ["user_id"], [F.col("event_id")], 20)


@query("filter_urls_with_fallback", """
WITH f AS (SELECT page_id, substr(url, 1, 12) AS src, contains(url, '.html') AS hit FROM pages WHERE NOT contains(url, 'spam')) SELECT page_id
FROM (SELECT *, max(hit) OVER (PARTITION BY src) AS h FROM f) WHERE hit OR NOT h
""")
def filter_urls_with_fallback(t):
    return P.with_fallback(t.pages.where(~F.col("url").contains("spam")).withColumn("src", F.substring("url", 1, 12)), ["src"], F.col("url").contains(".html")).select("page_id")


@query("filter_json_in_list", "SELECT user_id, count(*) AS n FROM swipes WHERE recipe_id IN (1, 2, 3, 5, 8) GROUP BY 1")
def filter_json_in_list(t):
    return t.events.where(F.get_json_object("props", "$.k").isin("1", "2", "3", "5", "8")).groupBy("user_id").agg(F.count("*").alias("n"))


# --- sorting, limits -------------------------------------------------------------------------


@query("topk_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_by_score(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("topk_per_user", """
SELECT user_id, swipe_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dwell DESC, swipe_id) r
FROM swipes) WHERE r <= 5
""")
def topk_per_user(t):
    return R.top_per(t.swipes, ["user_id"], [F.desc("dwell"), F.col("swipe_id")], 5).select("user_id", "swipe_id")


@query("paginate", "SELECT recipe_id, title, (SELECT count(*) FROM recipes) AS total FROM recipes ORDER BY recipe_id LIMIT 20 OFFSET 40")
def paginate(t):
    return R.page(t.recipes.select("recipe_id", "title"), ["recipe_id"], 40, 20, total=True)


@query("random_pick", "SELECT recipe_id FROM recipes ORDER BY md5(concat(recipe_id, ':42')), recipe_id LIMIT 10")
def random_pick(t):
    return R.hash_pick(t.recipes.select("recipe_id"), "recipe_id", 10, seed=42)


@query("sample_k", "SELECT vec_id FROM embeddings ORDER BY md5(concat(vec_id, ':7')), vec_id LIMIT 25")
def sample_k(t):
    return R.hash_pick(t.embeddings.select("vec_id"), "vec_id", 25, seed=7)


@query("sample_per_stratum", """
SELECT platform, recipe_id FROM (SELECT platform, recipe_id, row_number() OVER (PARTITION BY platform ORDER BY md5(concat(recipe_id, ':1')), recipe_id) AS n
FROM recipes) WHERE n = 1
""")
def sample_per_stratum(t):
    return R.sample_per(t.recipes.select("platform", "recipe_id"), ["platform"], "recipe_id", seed=1)


@query("overfetch_then_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def overfetch_then_filter(t):
    return t.orders.where("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey")


@query("pending_queue", """
SELECT feedback_id, type, CASE WHEN type = 'rating' THEN CAST(rating AS STRING) ELSE type END AS detail
FROM feedback WHERE status = 'pending' AND type <> 'report' ORDER BY created_at DESC, feedback_id LIMIT 50
""")
def pending_queue(t):
    return t.feedback.where("status = 'pending' AND type <> 'report'").orderBy(F.desc("created_at"), "feedback_id").limit(50).select("feedback_id", "type", F.when(F.col("type") == "rating", F.col("rating").cast("string")).otherwise(F.col("type")).alias("detail"))


@query("ordered_children", "SELECT conv_id, list(substr(text, 1, 10) ORDER BY turn, text) AS steps FROM conversations GROUP BY 1")
def ordered_children(t):
    return R.ordered_list(t.conversations.withColumn("head", F.substring("text", 1, 10)), "conv_id", ["turn", "text"], "head", "steps")


# --- sets ------------------------------------------------------------------------------------


@query("exclusion_union", f"""
SELECT user_id, recipe_id FROM swipes WHERE action = 'long_press_left' UNION SELECT user_id, recipe_id
FROM recommendations WHERE recommended_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
""")
def exclusion_union(t):
    return R.exclusions(t.swipes, t.recommendations, as_of(), 7)


@query("url_union", "SELECT url FROM pages UNION SELECT source_url FROM recipes")
def url_union(t):
    return t.pages.select("url").union(t.recipes.select("source_url")).distinct()


@query("region_difference", """
SELECT user_id, list_sort(list_filter(['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'], lambda x: x <> region_1 AND x <> region_2)) AS others
FROM profiles
""")
def region_difference(t):
    return t.profiles.select("user_id", F.array_sort(F.array_except(F.array(*map(F.lit, ["Brand#1", "Brand#2", "Brand#3", "Brand#4"])), F.array("region_1", "region_2"))).alias("others"))


@query("word_intersection", "SELECT recipe_id, CAST(len(list_intersect(string_split(title, ' '), ['red', 'widget', 'small'])) AS INT) AS shared FROM recipes")
def word_intersection(t):
    return t.recipes.select("recipe_id", F.size(F.array_intersect(F.split("title", " "), F.array(*map(F.lit, ["red", "widget", "small"])))).alias("shared"))


_DAIRY = [*P.DAIRY, "makhan", "rabdi", "khoya", "mawa", "large"]


@query("quota_union", f"""
WITH d AS (
  SELECT recipe_id, CASE WHEN bool_or(is_non_veg) THEN 'non_veg' WHEN bool_or(contains(lower(standard_name), 'egg')) THEN 'veg_eggs' ELSE 'pure_veg' END AS diet, NOT bool_or(is_allium OR is_root_vegetable) AS allium_free
  FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id GROUP BY 1),
f AS (SELECT r.recipe_id, d.diet, coalesce(allium_free, false) AS allium_free, regexp_matches(lower(title), '{"|".join(_DAIRY)}') AS has_dairy FROM recipes r LEFT JOIN d ON d.recipe_id = r.recipe_id WHERE title IS NOT NULL AND source_url IS NOT NULL),
k AS (SELECT row_number() OVER () AS kind, * FROM (SELECT DISTINCT region_1, region_2, diet, allium_status = 'no_both' AS no_allium, is_dairy_free FROM profiles)),
o AS (
  SELECT k.*, recipe_id FROM k JOIN f ON (f.diet = k.diet OR k.diet NOT IN (SELECT diet FROM f WHERE diet IS NOT NULL))
  AND (NOT no_allium OR allium_free OR (SELECT NOT bool_or(allium_free) FROM f)) AND NOT (is_dairy_free AND has_dairy)),
g AS (SELECT DISTINCT recipe_id, tag_value FROM tags WHERE dimension = 'region'),
v AS (SELECT DISTINCT region, tag_value FROM (SELECT region_1 AS region FROM k UNION SELECT region_2 FROM k), (SELECT DISTINCT tag_value FROM g) WHERE contains(lower(tag_value), lower(region))),
n AS (SELECT DISTINCT region, recipe_id FROM v JOIN g ON g.tag_value = v.tag_value),
q AS (
  SELECT kind, recipe_id, branch, row_number() OVER (PARTITION BY kind, branch ORDER BY recipe_id) AS place
  FROM (SELECT o.kind, o.recipe_id, 0 AS branch FROM o JOIN n ON n.recipe_id = o.recipe_id AND region = region_1 UNION ALL SELECT o.kind, o.recipe_id, 1 FROM o JOIN n ON n.recipe_id = o.recipe_id AND region = region_2)),
c AS (SELECT kind, recipe_id, min(branch) AS branch FROM q WHERE place <= 5 GROUP BY 1, 2),
z AS (
  SELECT kind, recipe_id, row_number() OVER (PARTITION BY kind ORDER BY md5(concat(recipe_id, ':7')), recipe_id) AS place FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.kind = o.kind AND c.recipe_id = o.recipe_id)),
b AS (SELECT * FROM c UNION ALL SELECT z.kind, recipe_id, 2 FROM z LEFT JOIN (SELECT kind, count(*) AS n FROM c GROUP BY 1) x ON x.kind = z.kind WHERE place <= 20 - coalesce(n, 0))
SELECT user_id, recipe_id, branch FROM profiles p JOIN k ON k.region_1 = p.region_1 AND k.region_2 = p.region_2 AND k.diet = p.diet AND k.no_allium = (p.allium_status = 'no_both') AND k.is_dairy_free = p.is_dairy_free JOIN b ON b.kind = k.kind
""")
def quota_union(t):
    """Of the recipes that suit the user five of each region, then any others."""
    names = F.lower("standard_name")
    made = t.ingredients.join(t.master, "ingredient_id").groupBy("recipe_id").agg(F.bool_or("is_non_veg").alias("meat"), F.bool_or(names.contains("egg")).alias("egg"), (~F.bool_or(F.col("is_allium") | F.col("is_root_vegetable"))).alias("allium_free"))
    diet = F.when(F.col("meat"), "non_veg").when(F.col("egg"), "veg_eggs").otherwise("pure_veg")
    recipes = t.recipes.where("title IS NOT NULL AND source_url IS NOT NULL").select("recipe_id", P.any_keyword("title", _DAIRY).alias("has_dairy")).join(made.select("recipe_id", diet.alias("diet"), "allium_free"), "recipe_id", "left")
    users = t.profiles.select("user_id", "region_1", "region_2", "diet", (F.col("allium_status") == "no_both").alias("no_allium"), F.col("is_dairy_free").alias("dairy_free"))
    return C.regional_candidates(users, recipes, t.tags.where("dimension = 'region'").select("recipe_id", "tag_value"), 20, 7)


@query("card_buckets_union", """
WITH a AS (SELECT user_id, recipe_id, 'liked' AS card_type, 0 AS b FROM swipes WHERE action = 'right'
UNION ALL SELECT user_id, recipe_id, 'saved', 1 FROM swipes WHERE action = 'save'), d AS (SELECT DISTINCT *
FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, card_type ORDER BY recipe_id) AS n
FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b, recipe_id) AS m
FROM n WHERE (b = 0 AND n <= 5) OR (b = 1 AND n <= 3)) SELECT user_id, recipe_id, card_type
FROM k WHERE m <= 7
""")
def card_buckets_union(t):
    liked, saved = (t.swipes.where(F.col("action") == a).select("user_id", "recipe_id").distinct() for a in ("right", "save"))
    return R.card_buckets([("liked", liked, [F.col("recipe_id")], 5), ("saved", saved, [F.col("recipe_id")], 3)], "user_id", 7)


@query("bfs_link_closure", """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % 97 AS b FROM lineitem WHERE l_linenumber < 3), r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def bfs_link_closure(t):
    links = t.lineitem.where("l_linenumber < 3").select(F.col("l_suppkey").alias("a"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 97).alias("b")).distinct()
    return R.reachable(links, t.spark.range(1, 2).select("id"), 3)
