"""The engine's tables (recipes, ingredients, tags, events ...) as views of the given base tables.

The statements are in the common part of Spark's and DuckDB's SQL, so both sides of a check read
the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

ADAPTERS = {
    "recipes": """SELECT o.o_orderkey AS recipe_id, o.o_custkey AS creator_id, concat(p.p_name, ' ', lower(p.p_type)) AS title,
        concat(o.o_orderpriority, ' ', p.p_type, ' ', p.p_brand) AS description, CAST(5 + o.o_orderkey % 115 AS INT) AS total_time_minutes,
        CAST(1 + o.o_orderkey % 6 AS INT) AS servings, o.o_orderdate AS processed_at, o.o_orderstatus AS platform,
        concat('https://x/', CAST(o.o_orderkey % 9000 AS STRING)) AS source_url,
        CASE o.o_orderkey % 4 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'snack' ELSE 'dinner' END AS meal_slot
        FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 200""",
    "ingredients": """SELECT l_orderkey AS recipe_id, l_linenumber AS line, l_partkey AS ingredient_id, l_quantity AS quantity,
        CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'g' WHEN 'RF' THEN 'kg' WHEN 'NO' THEN 'cup' WHEN 'NF' THEN 'tsp' WHEN 'AF' THEN 'piece' ELSE 'ml' END AS unit FROM lineitem""",
    "master": """SELECT p_partkey AS ingredient_id, p_name AS standard_name, p_brand AS synonym, CASE p_type WHEN 'STANDARD' THEN 'vegetable' WHEN 'PROMO' THEN 'grain' WHEN 'SMALL' THEN 'spice'
        WHEN 'LARGE' THEN 'dairy' WHEN 'ECONOMY' THEN 'legume' ELSE 'fruit' END AS category, p_size % 7 = 0 AS is_allium, p_size % 11 = 0 AS is_root_vegetable, p_size % 3 = 0 AS is_vrat_allowed,
        p_size % 13 = 0 AS is_non_veg, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 20 + p_size END AS glycemic_index, CAST(p_size AS DOUBLE) / 2 AS protein_per_100g FROM part""",
    "nutrition": """SELECT p_partkey AS ingredient_id, p_retailprice / 4 AS calories, CAST(p_size AS DOUBLE) / 2 AS protein_g, CAST(p_size AS DOUBLE) AS carbs_g, CAST(p_size AS DOUBLE) / 5 AS fat_g,
        CAST(p_size AS DOUBLE) / 10 AS fiber_g, CAST(p_size AS DOUBLE) / 8 AS sugar_g, CAST(p_size AS DOUBLE) * 3 AS sodium_mg FROM part WHERE p_partkey % 10 <> 0""",
    "tags": """SELECT (l_orderkey * 100 + l_linenumber) * 10 + 1 AS tag_id, l_orderkey AS recipe_id, 'texture' AS dimension, p_type AS tag_value, round(1 - l_discount, 2) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT (l_orderkey * 100 + l_linenumber) * 10 + 2, l_orderkey, 'region', p_brand, round(1 - l_discount, 2) FROM lineitem JOIN part ON p_partkey = l_partkey
        UNION ALL SELECT (l_orderkey * 100 + l_linenumber) * 10 + 3, l_orderkey, 'spice', concat('spice_', CAST(1 + p_size % 5 AS STRING)), round(1 - l_discount, 2) FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "swipes": """SELECT event_id AS swipe_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS recipe_id, ts AS swiped_at,
        CASE event_type WHEN 'purchase' THEN 'made_it' WHEN 'click' THEN 'right' WHEN 'view' THEN 'view' WHEN 'error' THEN 'long_press_left' ELSE 'save' END AS action, value AS dwell FROM events""",
    "cooks": """SELECT event_id AS cook_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS recipe_id, ts AS cooked_at,
        CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS would_make_again, CASE event_id % 4 WHEN 0 THEN 'too_spicy' WHEN 1 THEN 'too_mild' ELSE 'just_right' END AS spice_feedback FROM events WHERE event_type = 'purchase'""",
    "recommendations": """SELECT event_id AS rec_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS recipe_id, ts AS recommended_at, event_id % 5 = 0 AS was_saved, event_id % 7 = 0 AS was_cooked FROM events WHERE event_type = 'view'""",
    "feedback": """SELECT o_orderkey AS feedback_id, o_custkey AS recipe_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS rating, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'applied' ELSE 'reviewed' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'rating' WHEN 1 THEN 'correction' ELSE 'report' END AS type FROM orders""",
    "profiles": """SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'pure_veg' WHEN 'MACHINERY' THEN 'veg_eggs' ELSE 'non_veg' END AS diet, CAST(1 + c_custkey % 5 AS INT) AS heat, CAST(20 + c_custkey % 60 AS INT) AS time_budget,
        concat('Brand#', CAST(1 + c_custkey % 25 AS STRING)) AS region_1, concat('Brand#', CAST(1 + c_custkey * 7 % 25 AS STRING)) AS region_2, CASE c_custkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'no_onion' WHEN 2 THEN 'no_garlic' ELSE 'no_both' END AS allium_status,
        CASE c_custkey % 3 WHEN 0 THEN 'joint_family' WHEN 1 THEN 'i_cook_myself' ELSE 'manage_help' END AS household, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'ring' END AS prohibition, c_custkey % 5 = 0 AS is_dairy_free, CASE c_custkey % 3 WHEN 0 THEN 'gravy' WHEN 1 THEN 'dry' ELSE 'both' END AS gravy,
        CASE c_custkey % 6 WHEN 0 THEN 'STANDARD' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'ECONOMY' ELSE 'PROMO' END AS flavour, CASE c_custkey % 4 WHEN 0 THEN 'balanced' WHEN 1 THEN 'rich' ELSE 'light' END AS style,
        c_custkey % 10 = 0 AS is_vrat, c_custkey % 9 = 0 AS is_diabetic, CASE WHEN c_custkey % 7 = 0 THEN 'hot plate' ELSE '' END AS excluded FROM customer""",
}


class Tables:
    """Base tables and adapted tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = ADAPTERS[name]
        used = [b for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", sql)]
        for b in used:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(sql, **{b: getattr(self, b) for b in used})
