"""Queries over joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladle.operators import dietary as D
from ladle.operators import joins as J
from ladle.operators import learning as L
from ladle.operators import nutrition as N
from ladle.operators import ranking as R
from ladle.plans.registry import AS_OF, as_of, query



def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- joins -----------------------------------------------------------------------------------


@query("join_inner_ingredients", """
SELECT recipe_id, i.ingredient_id, standard_name, category FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id
""")
def join_inner_ingredients(t):
    return t.ingredients.join(t.master, "ingredient_id").select("recipe_id", "ingredient_id", "standard_name", "category")


@query("join_left_nutrition", """
SELECT recipe_id, count(*) AS n, count(*) FILTER (WHERE n.ingredient_id IS NULL) AS missing
FROM ingredients i LEFT JOIN nutrition n ON n.ingredient_id = i.ingredient_id GROUP BY 1
""")
def join_left_nutrition(t):
    return J.count_missing(t.ingredients, t.nutrition)


@query("join_tags_dimension", "SELECT r.recipe_id, t.dimension, t.tag_value FROM recipes r JOIN tags t ON t.recipe_id = r.recipe_id ")
def join_tags_dimension(t):
    return t.recipes.select("recipe_id").join(t.tags, "recipe_id").select("recipe_id", "dimension", "tag_value")


@query("semi_join_tag", """
SELECT recipe_id FROM recipes WHERE recipe_id IN (SELECT recipe_id FROM tags WHERE dimension = 'region' AND tag_value IN ('Brand#1', 'Brand#2'))
""")
def semi_join_tag(t):
    return t.recipes.select("recipe_id").join(t.tags.where("dimension = 'region' AND tag_value IN ('Brand#1', 'Brand#2')"), "recipe_id", "left_semi")


@query("anti_join_unprocessed", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT recipe_id FROM recipes WHERE recipe_id % 3 = 0)")
def anti_join_unprocessed(t):
    return t.pages.select("page_id").join(t.recipes.where("recipe_id % 3 = 0").select(F.col("recipe_id").alias("page_id")), "page_id", "left_anti")


@query("anti_join_untagged", "SELECT recipe_id FROM recipes r WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.recipe_id = r.recipe_id)")
def anti_join_untagged(t):
    return t.recipes.select("recipe_id").join(t.tags, "recipe_id", "left_anti")


@query("anti_join_new_urls", """
SELECT platform, source_url FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY source_url) r
FROM (SELECT DISTINCT platform, source_url FROM recipes WHERE platform <> 'F' AND source_url NOT IN (SELECT source_url
FROM recipes WHERE platform = 'F'))) WHERE r <= 100
""")
def anti_join_new_urls(t):
    known = t.recipes.where("platform = 'F'").select("source_url")
    new = t.recipes.where("platform <> 'F'").select("platform", "source_url").distinct().join(known, "source_url", "left_anti")
    return R.top_per(new, ["platform"], [F.col("source_url")], 100).select("platform", "source_url")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("point_id"), F.when(F.col("vec_id") % 50 != 7, F.col("vec_id")).alias("recipe_id"))


def _valid(t):
    """The recipes that vectors are checked against."""
    return t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("recipe_id"))


@query("orphan_embeddings", """
SELECT vec_id AS point_id, CASE WHEN vec_id % 50 = 7 THEN 'NO_RECIPE_ID' ELSE 'ORPHAN' END AS reason
FROM embeddings WHERE vec_id % 50 = 7 OR vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
""")
def orphan_embeddings(t):
    return J.orphans(_vectors(t), _valid(t)).select("point_id", "reason")


@query("missing_embeddings", "SELECT o_orderkey AS recipe_id FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(t):
    return t.orders.select(F.col("o_orderkey").alias("recipe_id")).join(t.embeddings.select(F.col("vec_id").alias("recipe_id")), "recipe_id", "left_anti")


@query("join_left_or_tags", """
WITH veg AS (SELECT recipe_id FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id GROUP BY 1 HAVING NOT bool_or(is_non_veg)),
k AS (SELECT DISTINCT region_1, region_2, coalesce(diet = 'pure_veg', false) AS veg, coalesce(style = 'rich', false) AS rich FROM profiles),
m AS (SELECT DISTINCT k.*, r.recipe_id FROM recipes r LEFT JOIN (SELECT recipe_id, tag_value FROM tags WHERE dimension = 'region') g ON g.recipe_id = r.recipe_id
  JOIN k ON g.tag_value = k.region_1 OR g.tag_value = k.region_2 OR coalesce(k.region_1, k.region_2) IS NULL
  WHERE processed_at IS NOT NULL AND (NOT k.veg OR r.recipe_id IN (SELECT recipe_id FROM veg)) AND (NOT k.rich OR r.recipe_id IN (SELECT recipe_id FROM tags WHERE dimension = 'texture' AND tag_value IN ('LARGE', 'PROMO'))))
SELECT user_id, recipe_id FROM profiles p JOIN (SELECT *, row_number() OVER (PARTITION BY region_1, region_2, veg, rich ORDER BY recipe_id) AS n FROM m) x
ON x.region_1 IS NOT DISTINCT FROM p.region_1 AND x.region_2 IS NOT DISTINCT FROM p.region_2 AND x.veg = coalesce(p.diet = 'pure_veg', false) AND x.rich = coalesce(p.style = 'rich', false) WHERE n <= 2
""")
def join_left_or_tags(t):
    """Each user's first two recipes that match diet, one of the regions, and style; the diet's tags are made of the ingredients."""
    veg = t.ingredients.join(t.master, "ingredient_id").groupBy("recipe_id").agg(F.bool_or("is_non_veg").alias("meat")).where(~F.col("meat")).select("recipe_id", F.lit("diet").alias("dimension"), F.lit("diet_veg").alias("tag_value"))
    users = t.profiles.select("user_id", "region_1", "region_2", (F.col("diet") == "pure_veg").alias("veg"), (F.col("style") == "rich").alias("rich"))
    tags = t.tags.select("recipe_id", "dimension", "tag_value").union(veg)
    return J.first_matches(users, t.recipes.where("processed_at IS NOT NULL"), tags, "region", ["region_1", "region_2"], {"veg": ("diet", ["diet_veg"]), "rich": ("texture", ["LARGE", "PROMO"])}, 2)


@query("relational_division_tags", """
SELECT r.recipe_id FROM recipes r JOIN (SELECT recipe_id FROM tags GROUP BY 1 HAVING bool_or(dimension = 'texture' AND tag_value IN ('SMALL', 'LARGE'))
AND bool_or(dimension = 'spice' AND tag_value = 'spice_2')) t ON t.recipe_id = r.recipe_id
""")
def relational_division_tags(t):
    return J.all_tags(t.recipes.select("recipe_id"), t.tags, {"texture": ["SMALL", "LARGE"], "spice": ["spice_2"]})


@query("symmetric_pair_upsert", """
SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, 'title' AS method, max_by(l_discount, struct_pack(x := l_shipdate, y := l_discount)) AS score
FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2
""")
def symmetric_pair_upsert(t):
    return J.symmetric_pairs(t.lineitem.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("title").alias("method"), F.col("l_discount").alias("score"), F.col("l_shipdate").alias("computed_at")))


@query("user_recipe_scoring_join", """WITH r AS (SELECT recipe_id, tag_value AS region, min(spice) AS spice FROM (SELECT t.recipe_id, t.tag_value, CAST(substr(s.tag_value, 7) AS INT) AS spice FROM tags t JOIN tags s ON s.recipe_id = t.recipe_id AND s.dimension = 'spice' WHERE t.dimension = 'region') GROUP BY 1, 2)
SELECT user_id, recipe_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, recipe_id) AS rank FROM (SELECT p.user_id, r.recipe_id, 1 - abs(r.spice - p.heat) / 4.0 AS score FROM profiles p JOIN r ON r.region = p.region_1) WHERE score >= 0.3) WHERE rank <= 5""")
def user_recipe_scoring_join(t):
    tags = t.tags
    spice = tags.where("dimension = 'spice'").groupBy("recipe_id").agg(F.min(F.substring("tag_value", 7, 9).cast("int")).alias("spice"))
    recipes = tags.where("dimension = 'region'").select("recipe_id", F.col("tag_value").alias("region")).distinct().join(spice, "recipe_id")
    return J.scored_pairs(t.profiles.select("user_id", "region_1", "heat"), recipes, F.col("region") == F.col("region_1"), 1 - F.abs(F.col("spice") - F.col("heat")) / 4.0, 5, 0.3, kinds=["region_1", "heat"]).select("user_id", "recipe_id", *r6("score"), "rank")


@query("complement_map_join", """
WITH m AS (SELECT * FROM (VALUES ('STANDARD', 'SMALL'), ('STANDARD', 'PROMO'), ('LARGE', 'SMALL')) v(a, b)),
k AS (SELECT a, p_partkey, row_number() OVER (PARTITION BY a ORDER BY p_retailprice DESC, p_partkey) AS n FROM m JOIN part ON p_type = b)
SELECT d.p_partkey AS dish_id, k.p_partkey AS recipe_id FROM part d JOIN k ON k.a = d.p_type WHERE n <= 2
""")
def complement_map_join(t):
    dishes = t.part.select(F.col("p_partkey").alias("dish_id"), F.col("p_type").alias("dish_kind"))
    recipes = t.part.select(F.col("p_partkey").alias("recipe_id"), "p_type", "p_retailprice")
    return J.complement(dishes, {"STANDARD": ["SMALL", "PROMO"], "LARGE": ["SMALL"]}, recipes, "p_type", [F.desc("p_retailprice"), F.col("recipe_id")], 2)


@query("pantry_match_join", """SELECT recipe_id, count(*) AS total, count(*) FILTER (WHERE h) AS matched, round(least(count(*) FILTER (WHERE h) / count(*) + least(count(*) FILTER (WHERE h) / 5, 0.3), 1.0), 6) AS score
FROM (SELECT recipe_id, contains(lower(standard_name), 'widget') OR contains(lower(standard_name), 'red') OR contains(lower(synonym), 'widget') OR contains(lower(synonym), 'red') AS h FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id) GROUP BY 1""")
def pantry_match_join(t):
    return J.pantry_match(t.ingredients, t.master, ["Widget", "red", "x"]).select("recipe_id", "total", "matched", *r6("score"))


@query("rank_self_join", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY recipe_id) AS rank FROM (SELECT creator_id, recipe_id, title FROM recipes)), k AS (SELECT creator_id, recipe_id, rank, list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) > 3)) AS w FROM c WHERE rank <= 100)
SELECT a.creator_id, a.recipe_id, CASE count(*) FILTER (WHERE len(list_intersect(a.w, b.w)) >= 2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.2 END AS diversity FROM k a LEFT JOIN k b ON b.creator_id = a.creator_id AND b.rank < a.rank GROUP BY 1, 2""")
def rank_self_join(t):
    ranked = t.recipes.select("creator_id", "recipe_id", "title").withColumn("rank", F.row_number().over(Window.partitionBy("creator_id").orderBy("recipe_id"))).where("rank <= 100")
    return J.diversity(ranked, user="creator_id").select("creator_id", "recipe_id", "diversity")


@query("latest_match_join", """
WITH l AS (SELECT user_id, recipe_id, max_by(rec_id, struct_pack(a := recommended_at, b := rec_id)) AS rec_id
FROM recommendations GROUP BY 1, 2) SELECT swipe_id, rec_id FROM swipes s LEFT JOIN l ON l.user_id = s.user_id AND l.recipe_id = s.recipe_id
""")
def latest_match_join(t):
    return J.latest_match(t.swipes, t.recommendations, ["user_id", "recipe_id"]).select("swipe_id", "rec_id")


@query("join_action_effect", """
SELECT swipe_id, CASE action WHEN 'right' THEN 'liked' WHEN 'save' THEN 'saved' WHEN 'long_press_left' THEN 'rejected' ELSE 'neutral' END AS effect
FROM swipes
""")
def join_action_effect(t):
    effects = {"right": "liked", "save": "saved", "long_press_left": "rejected"}
    return t.swipes.select("swipe_id", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in effects.items() for x in kv)), F.col("action")), F.lit("neutral")).alias("effect"))


@query("nested_prefetch", """SELECT r.recipe_id, coalesce(c.c_name, 'Unknown') AS creator, coalesce(i.ingredients, []) AS ingredients FROM recipes r LEFT JOIN customer c ON c.c_custkey = r.creator_id
LEFT JOIN (SELECT recipe_id, list(concat(line, ':', ingredient_id, ':', CAST(quantity AS INT)) ORDER BY line, ingredient_id, quantity) AS ingredients FROM ingredients GROUP BY 1) i ON i.recipe_id = r.recipe_id""")
def nested_prefetch(t):
    r = t.recipes.join(t.customer.select(F.col("c_custkey").alias("creator_id"), "c_name"), "creator_id", "left").select("recipe_id", F.coalesce("c_name", F.lit("Unknown")).alias("creator"))
    full = J.nested(r, {"ingredients": (t.ingredients, ["line", "ingredient_id", "quantity"])}, "recipe_id")
    return full.withColumn("ingredients", F.transform("ingredients", lambda i: F.concat_ws(":", i["line"], i["ingredient_id"], i["quantity"].cast("int"))))


@query("cluster_members", """
SELECT source_url, recipe_id, c_name FROM recipes LEFT JOIN customer ON c_custkey = creator_id WHERE source_url IN (SELECT source_url
FROM recipes GROUP BY 1 HAVING count(*) > 1)
""")
def cluster_members(t):
    multi = t.recipes.groupBy("source_url").count().where("count > 1").select("source_url")
    return t.recipes.join(multi, "source_url", "left_semi").join(t.customer, F.col("c_custkey") == F.col("creator_id"), "left").select("source_url", "recipe_id", "c_name")


@query("array_fk_join", """
SELECT i.recipe_id AS plan_id, round(coalesce(sum(n.calories), 0), 6) AS calories, round(coalesce(sum(n.protein_g), 0), 6) AS protein_g
FROM ingredients i LEFT JOIN nutrition n ON n.ingredient_id = i.ingredient_id GROUP BY 1
""")
def array_fk_join(t):
    plans = t.ingredients.groupBy(F.col("recipe_id").alias("plan_id")).agg(F.collect_list("ingredient_id").alias("ids"))
    return J.array_totals(plans, "plan_id", "ids", t.nutrition.withColumnRenamed("ingredient_id", "recipe_id"), ["calories", "protein_g"]).select("plan_id", *r6("calories", "protein_g"))


@query("lookup_with_defaults", """
SELECT c_custkey AS user_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 1500.0 + c_custkey % 100 END, 2000.0) AS daily_calories
FROM customer
""")
def lookup_with_defaults(t):
    goals = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), (1500.0 + F.col("c_custkey") % 100).alias("goal"))
    return t.customer.select(F.col("c_custkey").alias("user_id")).join(goals, "user_id", "left").select("user_id", F.coalesce("goal", F.lit(2000.0)).alias("daily_calories"))


# --- aggregates ------------------------------------------------------------------------------


@query("count_by_group", "SELECT type, status, count(*) AS n FROM feedback GROUP BY 1, 2")
def count_by_group(t):
    return t.feedback.groupBy("type", "status").agg(F.count("*").alias("n"))


@query("global_avg_sum", """
SELECT round(avg(m), 6) AS mean, CAST(sum(n) AS BIGINT) AS total FROM (SELECT recipe_id, avg(rating) AS m, count(*) AS n
FROM feedback GROUP BY 1)
""")
def global_avg_sum(t):
    return L.rating_aggregate(t.feedback).agg(F.round(F.coalesce(F.avg("average_rating"), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.sum("total_ratings"), F.lit(0)).alias("total"))


@query("success_rate", """
SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*), 2) AS rate
FROM events
""")
def success_rate(t):
    ok = F.count_if(F.col("event_type") != "error")
    return t.events.agg(F.count("*").alias("total"), ok.alias("ok"), F.round(F.coalesce(F.try_divide(ok * 100.0, F.count("*")), F.lit(0.0)), 2).alias("rate"))


@query("nutrition_stats", """
SELECT count(*) FILTER (WHERE protein_g >= 15) AS high_protein, count(*) FILTER (WHERE carbs_g < 20) AS low_carb, round(avg(calories), 6) AS calories
FROM nutrition
""")
def nutrition_stats(t):
    return t.nutrition.agg(F.count_if(F.col("protein_g") >= 15).alias("high_protein"), F.count_if(F.col("carbs_g") < 20).alias("low_carb"), F.round(F.avg("calories"), 6).alias("calories"))


@query("pipeline_status", """
SELECT (SELECT count(*) FROM recipes) AS recipes, (SELECT count(*) FROM ingredients) AS ingredients, (SELECT count(*)
FROM embeddings) AS vectors, round((SELECT count(*) FROM ingredients) / (SELECT count(*) FROM recipes), 6) AS per_recipe
""")
def pipeline_status(t):
    one = [df.agg(F.count("*").alias(n)) for n, df in (("recipes", t.recipes), ("ingredients", t.ingredients), ("vectors", t.embeddings))]
    return one[0].join(one[1]).join(one[2]).withColumn("per_recipe", F.round(F.try_divide("ingredients", "recipes"), 6))  # single rows


@query("processing_rate_eta", f"""
SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS recent, round(count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) / 24.0, 6) AS per_hour,
round(count(*) / nullif(count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) / 24.0, 0), 6) AS eta_hours, round(count(DISTINCT user_id) * 100.0 / count(*), 6) AS share
FROM events
""")
def processing_rate_eta(t):
    recent = F.count_if(F.col("ts") >= as_of() - F.make_interval(days=F.lit(1)))
    return t.events.agg(recent.alias("recent"), F.round(recent / 24.0, 6).alias("per_hour"), F.round(F.try_divide(F.count("*"), recent / 24.0), 6).alias("eta_hours"), F.round(F.count_distinct("user_id") * 100.0 / F.count("*"), 6).alias("share"))


@query("cost_estimate", "SELECT round(count(*) * (1200 * 0.075 + 400 * 0.3) / 1000000, 6) AS cost FROM recipes")
def cost_estimate(t):
    return t.recipes.agg(F.round(F.count("*") * (1200 * 0.075 + 400 * 0.3) / 1_000_000, 6).alias("cost"))


@query("duplicate_stats", """
SELECT count(*) AS urls, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS surplus
FROM (SELECT source_url, count(*) AS n FROM recipes GROUP BY 1 HAVING count(*) > 1)
""")
def duplicate_stats(t):
    return t.recipes.groupBy("source_url").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("urls"), F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("surplus"))


@query("embedding_duplicate_stats", """
SELECT vec_id % 300 AS recipe_id, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, recipe_id LIMIT 10
""")
def embedding_duplicate_stats(t):
    return t.embeddings.groupBy((F.col("vec_id") % 300).alias("recipe_id")).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "recipe_id").limit(10)


@query("group_invalid_by_type", """
SELECT CASE WHEN contains(substr(html, 1, 20), 'PNG') THEN 'binary_image' WHEN NOT contains(html, '<h1>') THEN 'no_metadata' ELSE 'ok' END AS issue, count(*) AS n
FROM pages GROUP BY 1
""")
def group_invalid_by_type(t):
    from ladle.operators.filters import html_issue

    return t.pages.groupBy(html_issue("html", F.col("html").contains("<h1>")).alias("issue")).agg(F.count("*").alias("n"))


@query("rating_aggregate", """
SELECT recipe_id, count(*) AS total_ratings, round(avg(rating), 6) AS average_rating, count(*) FILTER (WHERE rating = 5) AS rating_5, count(*) FILTER
(WHERE rating = 1) AS rating_1 FROM feedback GROUP BY 1
""")
def rating_aggregate(t):
    return L.rating_aggregate(t.feedback).select("recipe_id", "total_ratings", *r6("average_rating"), "rating_5", "rating_1")


@query("rating_distribution", """
SELECT recipe_id, round(avg(rating), 2) AS mean, [count(*) FILTER (WHERE rating = 1), count(*) FILTER (WHERE rating = 2), count(*) FILTER
(WHERE rating = 3), count(*) FILTER (WHERE rating = 4), count(*) FILTER (WHERE rating = 5)] AS stars
FROM feedback GROUP BY 1
""")
def rating_distribution(t):
    return L.rating_aggregate(t.feedback).select("recipe_id", F.round("average_rating", 2).alias("mean"), F.array(*(f"rating_{k}" for k in range(1, 6))).alias("stars"))


@query("bayesian_rating", """
SELECT c_custkey AS recipe_id, round(coalesce(n / (n + 10.0) * m / 5 + 10 / (n + 10.0) * 0.7, 0.5), 6) AS score
FROM customer LEFT JOIN (SELECT recipe_id, count(*) AS n, avg(rating) AS m FROM feedback GROUP BY 1) ON recipe_id = c_custkey
""")
def bayesian_rating(t):
    return t.customer.select(F.col("c_custkey").alias("recipe_id")).join(L.rating_aggregate(t.feedback), "recipe_id", "left").select("recipe_id", F.round(L.bayesian_rating(F.col("total_ratings"), F.col("average_rating")), 6).alias("score"))


@query("trending", """
SELECT recipe_id, count(*) AS n, round(avg(rating), 6) AS mean FROM feedback WHERE rating >= 4 AND created_at >= TIMESTAMP '2001-08-01' - INTERVAL 365 DAY
GROUP BY 1 ORDER BY n DESC, mean DESC, recipe_id LIMIT 10
""")
def trending(t):
    return L.trending(t.feedback, F.lit("2001-08-01").cast("timestamp_ntz"), 365).select("recipe_id", "n", *r6("mean"))


_G = """CASE WHEN unit IN ('cup', 'ml') AND (contains(lower(standard_name), 'rice') OR contains(lower(standard_name), 'flour')) THEN 200 WHEN unit IN ('cup', 'ml') AND (contains(lower(standard_name), 'oil') OR contains(lower(standard_name), 'ghee')) THEN 220
WHEN unit = 'cup' THEN 240 WHEN unit = 'tsp' THEN 5 WHEN unit = 'kg' THEN 1000 WHEN unit = 'piece' THEN 100 ELSE 1 END"""
_NUTRITION = f"""u AS (SELECT i.recipe_id, quantity * {_G} / 100 AS g, n.* EXCLUDE (ingredient_id), n.ingredient_id IS NULL AS miss FROM ingredients i LEFT JOIN master m ON m.ingredient_id = i.ingredient_id LEFT JOIN nutrition n ON n.ingredient_id = i.ingredient_id),
s AS (SELECT u.recipe_id, servings, sum(coalesce(calories, 0) * g) AS calories, sum(coalesce(protein_g, 0) * g) AS protein, sum(coalesce(carbs_g, 0) * g) AS carbs, sum(coalesce(fat_g, 0) * g) AS fat, sum(coalesce(fiber_g, 0) * g) AS fiber, count(*) AS total, count(*) FILTER (WHERE miss) AS missing FROM u JOIN recipes r ON r.recipe_id = u.recipe_id GROUP BY 1, 2)"""


def _nutrition(t):
    return N.recipe_nutrition(t.recipes, t.ingredients, t.master, t.nutrition)


@query("unit_to_grams", f"SELECT recipe_id, line, round(quantity * {_G}, 6) AS grams FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id")
def unit_to_grams(t):
    return t.ingredients.join(t.master, "ingredient_id").select("recipe_id", "line", F.round(N.unit_to_grams(F.col("quantity"), F.col("unit"), F.col("standard_name")), 6).alias("grams"))


@query("recipe_nutrition", f"""WITH {_NUTRITION} SELECT recipe_id, round(calories + 1e-7, 4) AS calories, round(protein / servings + 1e-7, 4) AS protein_serving, round(CASE WHEN protein * 4 + carbs * 4 + fat * 9 > 0 THEN protein * 4 / (protein * 4 + carbs * 4 + fat * 9) * 100 ELSE 0 END, 6) AS protein_percentage,
protein / servings >= 15 AS is_high_protein, carbs / servings < 20 AS is_low_carb, calories / servings < 300 AS is_low_calorie, round((carbs / servings - fiber / servings) * 50 / 100 + 1e-7, 4) AS glycemic_load, round(1 - missing / total, 6) AS confidence, missing, total FROM s""")
def recipe_nutrition(t):
    return _nutrition(t).select("recipe_id", F.round(F.col("total_calories") + 1e-7, 4).alias("calories"), F.round(F.col("serving_protein_g") + 1e-7, 4).alias("protein_serving"), *r6("protein_percentage"), "is_high_protein", "is_low_carb", "is_low_calorie", F.round(F.col("glycemic_load") + 1e-7, 4).alias("glycemic_load"), *r6("confidence"), F.col("missing_ingredient_count").alias("missing"), F.col("total_ingredient_count").alias("total"))


@query("nutrition_batch_report", """
SELECT success, count(*) AS n FROM (SELECT o_orderkey, EXISTS (SELECT 1 FROM ingredients WHERE recipe_id = o_orderkey) AS success
FROM orders) GROUP BY 1
""")
def nutrition_batch_report(t):
    return N.batch_report(t.recipes.select("recipe_id"), _nutrition(t)).groupBy("success").agg(F.count("*").alias("n"))


@query("nutrition_label", f"""
WITH {_NUTRITION} SELECT recipe_id, round(calories / servings + 1e-7, 0) AS calories, round(protein / servings + 1e-7, 1) AS protein,
round(carbs / servings + 1e-7, 1) AS carbs, round(fat / servings + 1e-7, 1) AS fat FROM s
""")
def nutrition_label(t):
    return N.nutrition_label(_nutrition(t)).select("recipe_id", "label.*")


@query("goal_comparison", f"""WITH {_NUTRITION}, g AS (SELECT c_custkey AS user_id, c_custkey % 2 = 0 AS hp, c_custkey % 3 = 0 AS lc FROM customer)
SELECT user_id, s.recipe_id, round(calories / s.servings / 2000 * 100 + 1e-7, 4) AS pct_calories, round(protein / s.servings / 50 * 100 + 1e-7, 4) AS pct_protein_g, round(CASE WHEN hp AND lc THEN (CASE WHEN protein / s.servings >= 15 THEN 1 ELSE 0.5 END + CASE WHEN carbs / s.servings < 20 THEN 1 ELSE 0.5 END) / 2 WHEN hp THEN CASE WHEN protein / s.servings >= 15 THEN 1 ELSE 0.5 END WHEN lc THEN CASE WHEN carbs / s.servings < 20 THEN 1 ELSE 0.5 END ELSE 0.5 END, 6) AS alignment
FROM g JOIN (SELECT recipe_id, creator_id FROM recipes) r ON r.creator_id = g.user_id JOIN s ON s.recipe_id = r.recipe_id""")
def goal_comparison(t):
    goals = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit(2000.0).alias("daily_calories"), F.lit(50.0).alias("daily_protein_g"), F.lit(300.0).alias("daily_carbs_g"), F.lit(65.0).alias("daily_fat_g"), (F.col("c_custkey") % 2 == 0).alias("prefer_high_protein"), (F.col("c_custkey") % 3 == 0).alias("prefer_low_carb"), F.lit(False).alias("prefer_low_calorie"))
    pairs = t.recipes.select(F.col("creator_id").alias("user_id"), "recipe_id")
    return N.goal_comparison(_nutrition(t), goals, pairs).select("user_id", "recipe_id", "pct_calories", "pct_protein_g", "alignment")


_RULE = "FROM recipes r LEFT JOIN (ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id) ON i.recipe_id = r.recipe_id GROUP BY r.recipe_id"


def _rules(t):
    return D.dietary_rules(t.recipes, t.ingredients, t.master, gluten=[*D.GLUTEN, "gear"], beneficial=[*D.BENEFICIAL, "bolt"])


def _listed(case: str) -> str:
    return f"coalesce(list({case} ORDER BY {case}) FILTER (WHERE {case} IS NOT NULL), [])"


@query("jain_check", f"""WITH v AS (SELECT recipe_id, concat(standard_name, ' (allium)') AS v FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id WHERE is_allium UNION ALL SELECT recipe_id, concat(standard_name, ' (root vegetable)') FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id WHERE is_root_vegetable)
SELECT r.recipe_id, count(v) = 0 AS is_jain, {_listed('v')} AS jain_violations FROM recipes r LEFT JOIN v ON v.recipe_id = r.recipe_id GROUP BY 1""")
def jain_check(t):
    return _rules(t).select("recipe_id", "is_jain", "jain_violations")


@query("vrat_check", f"""
SELECT r.recipe_id, coalesce(NOT bool_or(is_allium OR (category = 'grain' AND NOT is_vrat_allowed)) AND bool_or(category = 'grain' AND is_vrat_allowed), false) AS is_vrat, coalesce(bool_or(category = 'grain'
AND is_vrat_allowed), false) AS has_vrat_grain {_RULE}
""")
def vrat_check(t):
    return _rules(t).select("recipe_id", "is_vrat", "has_vrat_grain")


@query("diabetic_check", f"""
SELECT r.recipe_id, coalesce(avg(nullif(glycemic_index, 0)) < 55, false) OR coalesce(bool_or(contains(standard_name, 'bolt')), false) AS is_diabetic_friendly,
round(avg(nullif(glycemic_index, 0)), 6) AS average_gi, CASE WHEN avg(nullif(glycemic_index, 0)) IS NULL THEN 0.6 ELSE 0.8 END AS diabetic_confidence {_RULE}
""")
def diabetic_check(t):
    return _rules(t).select("recipe_id", "is_diabetic_friendly", *r6("average_gi"), "diabetic_confidence")


@query("high_protein_check", f"""
SELECT r.recipe_id, round(coalesce(sum(quantity * CASE WHEN unit = 'kg' THEN 1000 ELSE 1 END / 100 * protein_per_100g), 0) / max(servings) + 1e-7, 4) AS protein_per_serving {_RULE}
""")
def high_protein_check(t):
    return _rules(t).select("recipe_id", F.round(F.col("protein_per_serving") + 1e-7, 4).alias("protein_per_serving"))


@query("gluten_free_check", f"""
SELECT r.recipe_id, NOT coalesce(bool_or(contains(standard_name, 'gear')), false) AS is_gluten_free, {_listed(chr(39).join(['CASE WHEN contains(standard_name, ', 'gear', ') THEN standard_name END']))} AS gluten_violations {_RULE}
""")
def gluten_free_check(t):
    return _rules(t).select("recipe_id", "is_gluten_free", "gluten_violations")


@query("vegan_check", f"SELECT r.recipe_id, NOT coalesce(bool_or(category = 'dairy' OR contains(standard_name, 'egg')), false) AS is_vegan {_RULE}")
def vegan_check(t):
    return _rules(t).select("recipe_id", "is_vegan")


@query("dietary_tags", f"""WITH f AS (SELECT r.recipe_id, NOT coalesce(bool_or(is_allium OR is_root_vegetable), false) AS jain, coalesce(NOT bool_or(is_allium OR (category = 'grain' AND NOT is_vrat_allowed)) AND bool_or(category = 'grain' AND is_vrat_allowed), false) AS vrat, avg(nullif(glycemic_index, 0)) AS gi, coalesce(bool_or(contains(standard_name, 'bolt')), false) AS ben, NOT coalesce(bool_or(category = 'dairy' OR contains(standard_name, 'egg')), false) AS vegan {_RULE})
SELECT recipe_id, 'health_jain' AS dimension, CAST(jain AS STRING) AS tag_value, 1.0 AS confidence FROM f UNION ALL SELECT recipe_id, 'health_vrat', CAST(vrat AS STRING), 0.9 FROM f UNION ALL SELECT recipe_id, 'health_vegan', CAST(vegan AS STRING), 1.0 FROM f UNION ALL SELECT recipe_id, 'health_diabetic_friendly', CAST(gi < 55 OR ben AS STRING), 0.8 FROM f WHERE gi IS NOT NULL""")
def dietary_tags(t):
    return D.dietary_tags(_rules(t)).where(~F.col("dimension").isin("health_high_protein", "health_gluten_free"))


_SEEN = "SELECT user_id, action, tag_value FROM swipes s JOIN (SELECT DISTINCT recipe_id, tag_value FROM tags WHERE dimension = '{}') t ON t.recipe_id = s.recipe_id WHERE action IN ('right', 'long_press_left')"


@query("regional_affinity_swipes", f"""
SELECT user_id, tag_value, count(*) FILTER (WHERE action = 'right') AS likes, count(*) AS n, round(count(*) FILTER (WHERE action = 'right') / count(*), 6) AS affinity,
round(least(0.6 + 0.05 * count(*), 0.85), 6) AS confidence FROM ({_SEEN.format('region')}) GROUP BY 1, 2
""")
def regional_affinity_swipes(t):
    return L.affinity_by_likes(t.swipes, t.tags.where("dimension = 'region'")).select("user_id", "tag_value", "likes", "n", *r6("affinity", "confidence"))


@query("regional_affinity_signals", """WITH e AS (SELECT user_id, recipe_id, CASE action WHEN 'right' THEN 0.2 WHEN 'long_press_left' THEN -0.5 ELSE -0.05 END AS s FROM swipes UNION ALL SELECT user_id, recipe_id, CASE WHEN would_make_again THEN 0.7 ELSE 0.4 END FROM cooks)
SELECT user_id, tag_value, count(*) AS n, round(greatest(0, least(1, 0.5 + sum(CAST(s AS DOUBLE)))), 6) AS affinity, round(least(0.85, 0.5 + 0.05 * count(*)), 6) AS confidence FROM e JOIN (SELECT DISTINCT recipe_id, tag_value FROM tags WHERE dimension = 'region') t ON t.recipe_id = e.recipe_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def regional_affinity_signals(t):
    return L.affinity_by_signals(t.swipes, t.cooks, t.tags.where("dimension = 'region'")).select("user_id", "tag_value", "n", *r6("affinity", "confidence"))


@query("texture_affinity", f"""
SELECT user_id, tag_value, count(*) AS n, round(count(*) FILTER (WHERE action = 'right') / count(*), 6) AS affinity, round(least(0.5 + 0.1 * count(*), 0.75), 6) AS confidence
FROM ({_SEEN.format('texture')}) GROUP BY 1, 2 HAVING count(*) >= 2
""")
def texture_affinity(t):
    return L.texture_affinity(t.swipes, t.tags.where("dimension = 'texture'")).select("user_id", "tag_value", "n", *r6("affinity", "confidence"))


@query("spice_adjustment", """
SELECT user_id, CAST(CASE WHEN count(*) FILTER (WHERE spice_feedback = 'too_spicy') * 2 > count(*) THEN -1 WHEN count(*) FILTER (WHERE spice_feedback = 'too_mild') * 2 > count(*) THEN 1
ELSE 0 END AS INT) AS adjustment FROM cooks GROUP BY 1 HAVING count(*) >= 3
""")
def spice_adjustment(t):
    return L.spice_adjustment(t.cooks, 3)


FEEDBACK_SQL = """e AS (SELECT user_id, recipe_id, CASE action WHEN 'right' THEN 0.2 WHEN 'save' THEN 0.15 WHEN 'view' THEN 0.05 WHEN 'long_press_left' THEN -0.5 WHEN 'made_it' THEN 0.4 ELSE 0 END AS s FROM swipes UNION ALL SELECT user_id, recipe_id, 0.4 + CASE WHEN would_make_again THEN 0.3 WHEN NOT would_make_again THEN -0.2 ELSE 0 END FROM cooks),
k AS (SELECT DISTINCT recipe_id, concat(dimension, ':', tag_value) AS tag FROM tags), z AS (SELECT user_id, tag, sum(CAST(s AS DOUBLE)) AS s FROM e JOIN k ON k.recipe_id = e.recipe_id GROUP BY 1, 2), f AS (SELECT user_id, tag, coalesce(s / nullif(max(abs(s)) OVER (PARTITION BY user_id), 0), 0) AS score FROM z)"""


@query("tag_feedback_scores", f"WITH {FEEDBACK_SQL} SELECT user_id, tag, round(score, 6) AS score FROM f")
def tag_feedback_scores(t):
    return L.tag_feedback(t.swipes, t.cooks, t.tags).select("user_id", "tag", *r6("score"))


@query("recipe_feedback_score", f"""
WITH {FEEDBACK_SQL} SELECT p.user_id, p.recipe_id, round(coalesce(avg(score), 0) + 1e-9, 6) AS feedback
FROM (SELECT DISTINCT user_id, recipe_id FROM recommendations) p LEFT JOIN (k JOIN f ON f.tag = k.tag) ON k.recipe_id = p.recipe_id AND f.user_id = p.user_id
GROUP BY 1, 2
""")
def recipe_feedback_score(t):
    return L.recipe_feedback(L.tag_feedback(t.swipes, t.cooks, t.tags), t.tags, t.recommendations.select("user_id", "recipe_id").distinct()).select("user_id", "recipe_id", F.round(F.col("feedback") + 1e-9, 6).alias("feedback"))


@query("normalise_by_max_abs", """
SELECT c_custkey, round(coalesce(c_acctbal / nullif(max(abs(c_acctbal)) OVER (PARTITION BY c_nationkey), 0), 0), 6) AS score
FROM customer
""")
def normalise_by_max_abs(t):
    return L.normalised(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", "score").select("c_custkey", *r6("score"))


_RUNS = """b AS (SELECT user_id, recipe_id, swipe_id, action, sum(CASE WHEN action <> 'right' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY swiped_at, swipe_id) AS run FROM swipes), w AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last, count(*) FILTER (WHERE action = 'right') OVER (PARTITION BY user_id, run) AS n FROM b),
runs AS (SELECT user_id, CAST(run AS BIGINT) AS run, swipe_id, recipe_id FROM w WHERE action = 'right' AND run < last AND n >= 2)"""


@query("like_runs", f"WITH {_RUNS} SELECT * FROM runs")
def like_runs(t):
    return L.like_runs(t.swipes, 2)


@query("common_dimensions", f"""
WITH {_RUNS} SELECT h.user_id, h.run, dimension, tag_value, h.n FROM (SELECT user_id, run, dimension, tag_value, count(*) AS n
FROM runs JOIN (SELECT DISTINCT recipe_id, dimension, tag_value FROM tags) t ON t.recipe_id = runs.recipe_id GROUP BY ALL) h JOIN (SELECT user_id, run, count(*) AS size
FROM runs GROUP BY ALL) z ON z.user_id = h.user_id AND z.run = h.run WHERE h.n >= 0.5 * size
""")
def common_dimensions(t):
    return L.common_dimensions(L.like_runs(t.swipes, 2), t.tags)


@query("user_interaction_stats", """
SELECT s.user_id, swipes, likes, coalesce(c, 0) AS cooks, round(likes / swipes, 6) AS right_rate, round(coalesce(coalesce(c, 0) / nullif(likes, 0), 0), 6) AS cook_conversion, 10 - swipes % 10 AS next_refinement_in
FROM (SELECT user_id, count(*) AS swipes, count(*) FILTER (WHERE action = 'right') AS likes
FROM swipes GROUP BY 1) s LEFT JOIN (SELECT user_id, count(*) AS c FROM cooks GROUP BY 1) k ON k.user_id = s.user_id
""")
def user_interaction_stats(t):
    return L.interaction_stats(t.swipes, t.cooks).select("user_id", "swipes", "likes", "cooks", *r6("right_rate", "cook_conversion"), "next_refinement_in")


@query("profile_completeness", """
SELECT user_id, (CAST(diet IS NOT NULL AS INT) + CAST(prohibition IS NOT NULL AS INT) + CAST(heat > 1 AS INT) + CAST(region_1 <> region_2 AS INT)) / 4 AS completeness
FROM profiles
""")
def profile_completeness(t):
    filled = [F.col("diet").isNotNull(), F.col("prohibition").isNotNull(), F.col("heat") > 1, F.col("region_1") != F.col("region_2")]
    return t.profiles.select("user_id", (sum((f.cast("int") for f in filled), F.lit(0)) / len(filled)).alias("completeness"))


@query("profile_confidence", """
SELECT user_id, round((8 * 0.95 + n * 0.6) / (8 + n), 6) AS at_start, round(least(0.85 + least(0.001 * n + 0.01 * c, 0.10), 0.95), 6) AS learned
FROM (SELECT s.user_id, count(*) AS n, count(*) FILTER (WHERE action = 'made_it') AS c FROM swipes s GROUP BY 1)
""")
def profile_confidence(t):
    n, c = F.count("*"), F.count_if(F.col("action") == "made_it")
    return t.swipes.groupBy("user_id").agg(F.round((8 * 0.95 + n * 0.6) / (8 + n), 6).alias("at_start"), F.round(F.least(0.85 + F.least(0.001 * n + 0.01 * c, F.lit(0.10)), F.lit(0.95)), 6).alias("learned"))


@query("step_time_estimates", """
SELECT conv_id, CAST(sum(turn) AS BIGINT) AS total, CAST(floor(sum(turn) * 0.3) AS BIGINT) AS prep, CAST(sum(turn) - floor(sum(turn) * 0.3) AS BIGINT) AS cook
FROM conversations GROUP BY 1
""")
def step_time_estimates(t):
    total = F.coalesce(F.sum("turn"), F.lit(0))
    return t.conversations.groupBy("conv_id").agg(total.alias("total")).withColumn("prep", F.floor(F.col("total") * 0.3)).withColumn("cook", F.col("total") - F.col("prep"))


@query("report_by_segment", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(max(c_acctbal), 6) AS best FROM customer GROUP BY 1")
def report_by_segment(t):
    return t.customer.groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.max("c_acctbal"), 6).alias("best"))


@query("available_filters", "SELECT dimension, list_sort(list(DISTINCT tag_value)) AS allowed_values FROM tags GROUP BY 1")
def available_filters(t):
    return t.tags.groupBy("dimension").agg(F.array_sort(F.collect_set("tag_value")).alias("allowed_values"))


@query("distinct_urls", "SELECT DISTINCT source_url FROM recipes ORDER BY 1 LIMIT 500")
def distinct_urls(t):
    return t.recipes.select("source_url").distinct().orderBy("source_url").limit(500)


@query("visual_ingredient_dedup", """
SELECT name, line FROM (SELECT lower(p_name) AS name, p_partkey AS line, row_number() OVER (PARTITION BY lower(p_name) ORDER BY CASE WHEN p_size > 40 THEN 0
ELSE 1 END, CASE WHEN p_size > 40 THEN -p_partkey ELSE p_partkey END) AS r FROM part) WHERE r = 1
""")
def visual_ingredient_dedup(t):
    high = F.col("p_size") > 40
    seen = t.part.select(F.lower("p_name").alias("name"), F.col("p_partkey").alias("line"), "p_size")
    return R.latest_per(seen, ["name"], [F.when(high, 0).otherwise(1), F.when(high, -F.col("line")).otherwise(F.col("line"))]).select("name", "line")


# --- windows ---------------------------------------------------------------------------------


@query("dedup_keep_oldest", """
SELECT recipe_id FROM (SELECT recipe_id, row_number() OVER (PARTITION BY source_url ORDER BY processed_at, recipe_id) AS r
FROM recipes) WHERE r > 1
""")
def dedup_keep_oldest(t):
    return R.duplicates_after_first(t.recipes.select("recipe_id", "source_url", "processed_at"), ["source_url"], ["processed_at", "recipe_id"]).select("recipe_id")


@query("dedup_keep_first_vector", """
SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id % 300 ORDER BY vec_id) AS r
FROM embeddings) WHERE r > 1
""")
def dedup_keep_first_vector(t):
    return R.duplicates_after_first(t.embeddings.select("vec_id", (F.col("vec_id") % 300).alias("recipe_id")), ["recipe_id"], ["vec_id"]).select("vec_id")


@query("latest_per_key", """
SELECT user_id, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY recommended_at DESC, rec_id DESC) AS r
FROM recommendations) WHERE r = 1
""")
def latest_per_key(t):
    return R.latest_per(t.recommendations, ["user_id"], [F.desc("recommended_at"), F.desc("rec_id")]).select("user_id", "rec_id")


@query("top_n_per_user", """
SELECT user_id, cook_id, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cooked_at DESC, cook_id DESC) AS r
FROM cooks) c LEFT JOIN recipes USING (recipe_id) WHERE r <= 3
""")
def top_n_per_user(t):
    return R.top_per(t.cooks, ["user_id"], [F.desc("cooked_at"), F.desc("cook_id")], 3).join(t.recipes.select("recipe_id", "title"), "recipe_id", "left").select("user_id", "cook_id", "title")


@query("refinement_trigger", """
SELECT user_id, swipe_id, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY swiped_at, swipe_id) AS n
FROM swipes) WHERE n % 10 = 0
""")
def refinement_trigger(t):
    return L.refinement_triggers(t.swipes)


_GREEDY = "SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY total_time_minutes DESC, recipe_id) AS pos FROM (SELECT creator_id, recipe_id, total_time_minutes, servings FROM recipes)"


@query("greedy_diversify", f"""WITH c AS ({_GREEDY}), f AS (SELECT *, row_number() OVER (PARTITION BY creator_id, servings ORDER BY pos) = 1 AS fresh FROM c), g AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY creator_id ORDER BY pos) AS k FROM f),
a AS (SELECT *, fresh OR k > 3 OR (k = 3 AND NOT fresh) AS ok FROM g) SELECT creator_id, recipe_id FROM (SELECT *, row_number() OVER (PARTITION BY creator_id ORDER BY pos) AS r FROM a WHERE ok) WHERE r <= 5""")
def greedy_diversify(t):
    from ladle.operators.recommend import diversify

    return diversify(t.recipes.select("creator_id", "recipe_id", "total_time_minutes", "servings"), "creator_id", [F.desc("total_time_minutes"), F.col("recipe_id")], "servings", 5).select("creator_id", "recipe_id")


@query("renumber_steps", """
SELECT conv_id, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INT) AS step
FROM conversations WHERE role <> 'system'
""")
def renumber_steps(t):
    return t.conversations.where("role <> 'system'").select("conv_id", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("step"))


@query("best_match_per_row", """
SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r
FROM lineitem) WHERE r = 1
""")
def best_match_per_row(t):
    return R.latest_per(t.lineitem.select("l_orderkey", "l_partkey", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey")]).select("l_orderkey", "l_partkey")


@query("first_tag_value", "SELECT recipe_id, dimension, arg_min(tag_value, struct_pack(a := tag_id, b := tag_value)) AS tag_value FROM tags GROUP BY 1, 2")
def first_tag_value(t):
    return t.tags.groupBy("recipe_id", "dimension").agg(F.min_by("tag_value", F.struct("tag_id", "tag_value")).alias("tag_value"))
