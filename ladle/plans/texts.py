"""Queries over column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladle.functions import text as T
from ladle.operators import joins as J
from ladle.plans.registry import AS_OF, as_of, query

c = F.col

_TITLE = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_FIRST = "split_part(text, '.', 1)"


@query("normalize_title", f"SELECT doc_id, {_TITLE.format(_FIRST)} AS title FROM documents")
def normalize_title(t):
    return t.documents.select("doc_id", T.normalize_title(F.split_part("text", F.lit("."), F.lit(1))).alias("title"))


@query("canonical_title", """
SELECT p_partkey, concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS title
FROM part
""")
def canonical_title(t):
    return t.part.select("p_partkey", T.canonical_title(c("p_name")).alias("title"))


@query("slugify", "SELECT recipe_id, trim(regexp_replace(lower(description), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM recipes")
def slugify(t):
    return t.recipes.select("recipe_id", T.slugify(c("description")).alias("slug"))


@query("fuzz_ratio")
def fuzz_ratio(t):
    return t.part.select("p_partkey", T.fuzz_ratio(c("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_brand"))).alias("ratio"))


@query("levenshtein_ratio", """
SELECT recipe_id, round(1 - levenshtein(title, description) / greatest(length(title), length(description)), 6) AS ratio
FROM recipes
""")
def levenshtein_ratio(t):
    return t.recipes.select("recipe_id", F.round(T.levenshtein_ratio(c("title"), c("description")), 6).alias("ratio"))


_SETS = "SELECT recipe_id, list_distinct(list(ingredient_id % 40)) AS s FROM ingredients GROUP BY 1"


@query("jaccard", f"""
WITH s AS ({_SETS}) SELECT a.recipe_id, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score
FROM s a JOIN s b ON b.recipe_id = a.recipe_id + 1
""")
def jaccard(t):
    s = t.ingredients.groupBy("recipe_id").agg(F.collect_set(c("ingredient_id") % 40).alias("s"))
    return s.join(s.select((c("recipe_id") - 1).alias("recipe_id"), c("s").alias("o")), "recipe_id").select("recipe_id", F.round(T.jaccard(c("s"), c("o")), 6).alias("score"))


@query("cosine", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine(t):
    return t.embeddings.select("vec_id", "embedding").join(t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("o")), "vec_id").select("vec_id", F.round(T.cosine(c("embedding"), c("o")), 6).alias("score"))


_ISO = "concat('PT', CASE WHEN o_orderkey % 3 > 0 THEN concat(o_orderkey % 5, 'H') ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN concat(o_orderkey % 60, 'M') ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey % 60, 'S') ELSE '' END)"
_H, _M, _S = ("CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 ELSE 0 END", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE 0 END", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 60 ELSE 0 END")


@query("parse_iso_duration", f"SELECT o_orderkey, CAST(({_H}) * 60 + ({_M}) AS INT) AS minutes FROM orders")
def parse_iso_duration(t):
    return t.orders.select("o_orderkey", T.parse_iso_duration(F.expr(_ISO)).alias("minutes"))


@query("parse_iso_duration_seconds", f"SELECT o_orderkey, CAST(({_H}) * 3600 + ({_M}) * 60 + ({_S}) AS INT) AS seconds FROM orders")
def parse_iso_duration_seconds(t):
    return t.orders.select("o_orderkey", T.parse_iso_duration_seconds(F.expr(_ISO)).alias("seconds"))


@query("parse_servings", "SELECT recipe_id, servings FROM recipes")
def parse_servings(t):
    return t.recipes.select("recipe_id", T.parse_servings(F.concat(F.lit("Serves "), c("servings"), F.lit(" people or 9"))).alias("servings"))


@query("parse_ingredient", """
SELECT recipe_id, line, quantity, unit, concat(upper(substr(split_part(standard_name, ' ', 1), 1, 1)), substr(split_part(standard_name, ' ', 1), 2), ' ', upper(substr(split_part(standard_name, ' ', 2), 1, 1)), substr(split_part(standard_name, ' ', 2), 2)) AS item
FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id WHERE NOT contains(standard_name, 'small') AND NOT contains(standard_name, 'large')
""")
def parse_ingredient(t):
    text = F.concat(c("quantity").cast("int").cast("string"), F.lit(" "), c("unit"), F.lit(" "), c("standard_name"), F.lit(", chopped"))
    lines = t.ingredients.join(t.master, "ingredient_id").where("NOT contains(standard_name, 'small') AND NOT contains(standard_name, 'large')").select("recipe_id", "line", text.alias("text"))
    return T.parsed_lines(lines, "text")


@query("recipe_text", """
SELECT r.recipe_id, concat_ws(' | ', concat('Title: ', title), concat('Description: ', substr(description, 1, 500)), concat('Ingredients: ', string_agg(standard_name, ', '
ORDER BY line, standard_name))) AS text FROM recipes r JOIN ingredients i ON i.recipe_id = r.recipe_id JOIN master m ON m.ingredient_id = i.ingredient_id
GROUP BY r.recipe_id, title, description
""")
def recipe_text(t):
    names = t.ingredients.join(t.master, "ingredient_id").groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("line", "standard_name"))).alias("l"))
    return t.recipes.join(names, "recipe_id").select("recipe_id", F.concat_ws(" | ", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Description: "), F.substring("description", 1, 500)), F.concat(F.lit("Ingredients: "), F.array_join(F.transform("l", lambda x: x["standard_name"]), ", "))).alias("text"))


@query("embed_text", """
SELECT r.recipe_id, concat(title, '. ', description, '. Tags: ', string_agg(DISTINCT tag_value, ', ' ORDER BY tag_value)) AS text
FROM recipes r JOIN tags t ON t.recipe_id = r.recipe_id GROUP BY r.recipe_id, title, description
""")
def embed_text(t):
    values = t.tags.groupBy("recipe_id").agg(F.array_sort(F.collect_set("tag_value")).alias("v"))
    return t.recipes.join(values, "recipe_id").select("recipe_id", F.concat("title", F.lit(". "), "description", F.lit(". Tags: "), F.array_join("v", ", ")).alias("text"))


@query("profile_text", """
SELECT user_id, concat_ws(' ', concat('Diet: ', replace(diet, '_', ' '), '.'), CASE WHEN allium_status = 'no_both' THEN 'No onion or garlic.' END, concat('Heat level ', heat, ' of 5.'), concat('Cooks from ', region_1, ' and ', region_2, '.'), CASE
WHEN time_budget < 30 THEN 'Prefers quick dishes.' END, CASE WHEN is_dairy_free THEN 'No dairy.' END) AS text
FROM profiles
""")
def profile_text(t):
    return t.profiles.select("user_id", F.concat_ws(" ", F.concat(F.lit("Diet: "), F.replace("diet", F.lit("_"), F.lit(" ")), F.lit(".")), F.when(c("allium_status") == "no_both", "No onion or garlic."), F.concat(F.lit("Heat level "), "heat", F.lit(" of 5.")), F.concat(F.lit("Cooks from "), "region_1", F.lit(" and "), "region_2", F.lit(".")), F.when(c("time_budget") < 30, "Prefers quick dishes."), F.when(c("is_dairy_free"), "No dairy.")).alias("text"))


@query("meal_from_hour", """
SELECT event_id, CASE WHEN h BETWEEN 5 AND 10 THEN 'breakfast' WHEN h BETWEEN 11 AND 15 THEN 'lunch' WHEN h BETWEEN 16 AND 17 THEN 'snack'
ELSE 'dinner' END AS meal FROM (SELECT event_id, hour(ts + INTERVAL 330 MINUTE) AS h FROM events)
""")
def meal_from_hour(t):
    return t.events.select("event_id", T.meal_from_hour(c("ts").cast("timestamp")).alias("meal"))


@query("season_from_month", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'monsoon'
ELSE 'autumn' END AS season FROM orders
""")
def season_from_month(t):
    return t.orders.select("o_orderkey", T.season_from_month(F.month("o_orderdate")).alias("season"))


_DAYS = f"CAST(floor(epoch(TIMESTAMP '{AS_OF}' - ts) / 86400) AS BIGINT)"


@query("freshness_linear", f"SELECT event_id, round(greatest(0.5, 1 - {_DAYS} / 30 * 0.5), 6) AS score FROM events")
def freshness_linear(t):
    return t.events.select("event_id", F.round(T.freshness_linear(T.whole_days(c("ts"), as_of())), 6).alias("score"))


@query("freshness_bucket", f"SELECT event_id, CASE WHEN {_DAYS} < 7 THEN 1.0 WHEN {_DAYS} < 30 THEN 0.8 ELSE 0.6 END AS score FROM events")
def freshness_bucket(t):
    return t.events.select("event_id", T.freshness_bucket(T.whole_days(c("ts"), as_of())).alias("score"))


@query("diversity_decay", f"""
SELECT s.user_id, s.recipe_id, round(CASE WHEN d IS NULL OR d >= 14 THEN 1.0 WHEN k THEN greatest(0.7, d / 14) ELSE d / 14 END, 6) AS score
FROM (SELECT DISTINCT user_id, recipe_id FROM swipes) s LEFT JOIN (SELECT user_id, recipe_id, min({_DAYS.replace('ts', 'recommended_at')}) AS d, bool_or(was_saved
OR was_cooked) AS k FROM recommendations GROUP BY 1, 2) r ON r.user_id = s.user_id AND r.recipe_id = s.recipe_id
""")
def diversity_decay(t):
    shown = t.recommendations.groupBy("user_id", "recipe_id").agg(F.min(T.whole_days(c("recommended_at"), as_of())).alias("d"), F.bool_or(c("was_saved") | c("was_cooked")).alias("k"))
    return t.swipes.select("user_id", "recipe_id").distinct().join(shown, ["user_id", "recipe_id"], "left").select("user_id", "recipe_id", F.round(T.diversity_decay(c("d"), c("k")), 6).alias("score"))


@query("spice_match", """
SELECT tag_id, user_id, round(greatest(0, 1 - abs(CAST(substr(tag_value, 7) AS INT) - heat) / 4), 6) AS score
FROM tags JOIN profiles ON user_id = recipe_id WHERE dimension = 'spice'
""")
def spice_match(t):
    return t.tags.where("dimension = 'spice'").join(t.profiles, c("user_id") == c("recipe_id")).select("tag_id", "user_id", F.round(T.spice_match(F.substring("tag_value", 7, 2).cast("int"), c("heat")), 6).alias("score"))


def _textures(t):
    return t.tags.where("dimension = 'texture'").groupBy("recipe_id").agg(F.collect_set("tag_value").alias("v"))


@query("style_match", """
SELECT recipe_id, CASE WHEN recipe_id % 3 = 0 THEN 0.8 WHEN bool_or(tag_value IN ('SMALL', 'LARGE')) THEN 1.0 ELSE 0.3 END AS score
FROM tags WHERE dimension = 'texture' GROUP BY 1
""")
def style_match(t):
    return _textures(t).select("recipe_id", T.style_match(F.when(c("recipe_id") % 3 == 0, "balanced").otherwise("rich"), c("v"), F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("score"))


@query("gravy_match", "SELECT user_id, CASE gravy WHEN 'both' THEN 1.0 WHEN 'gravy' THEN 1.0 ELSE 0.3 END AS score FROM profiles")
def gravy_match(t):
    return t.profiles.select("user_id", T.gravy_match(c("gravy"), F.array(F.lit("gravy"))).alias("score"))


@query("discovered_bonus", "SELECT user_id, round(least(1.0, heat / 10 + 0.5 * (time_budget / 100)), 6) AS bonus FROM profiles")
def discovered_bonus(t):
    return t.profiles.select("user_id", F.round(F.least(F.lit(1.0), c("heat") / 10 + 0.5 * (c("time_budget") / 100)), 6).alias("bonus"))


@query("html_to_text", """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) AS text
FROM pages
""")
def html_to_text(t):
    return t.pages.select("page_id", T.html_to_text(c("html")).alias("text"))


@query("strip_nul", "SELECT page_id, length(html) AS n FROM pages")
def strip_nul(t):
    return t.pages.select("page_id", F.length(T.strip_nul(F.concat("html", F.lit("\x00")))).cast("long").alias("n"))


@query("resolve_url", """
SELECT page_id, concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/img/a.png') AS a, concat(regexp_extract(url, '^([a-z]+)://', 1), '://cdn.x/b') AS b, concat(regexp_extract(url, '^([a-z]+://[^?#]*/)', 1), 'c.png') AS c
FROM pages
""")
def resolve_url(t):
    return t.pages.select("page_id", T.resolve_url(c("url"), F.lit("/img/a.png")).alias("a"), T.resolve_url(c("url"), F.lit("//cdn.x/b")).alias("b"), T.resolve_url(c("url"), F.lit("c.png")).alias("c"))


_VID = "lpad(CAST(page_id AS STRING), 11, 'v')"


@query("video_id", f"SELECT page_id, {_VID} AS a, {_VID} AS b FROM pages")
def video_id(t):
    return t.pages.select("page_id", T.video_id(F.expr(f"concat('https://www.youtube.com/watch?v=', {_VID}, '&t=1')")).alias("a"), T.video_id(F.expr(f"concat('https://youtu.be/', {_VID})")).alias("b"))


@query("playlist_id", "SELECT page_id, concat('PL', page_id) AS id FROM pages")
def playlist_id(t):
    return t.pages.select("page_id", T.playlist_id(F.concat(F.lit("https://y.com/playlist?list=PL"), "page_id")).alias("id"))


@query("thumbnail_choice", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'maxres' WHEN page_id % 2 = 0 THEN 'sd' ELSE 'default' END AS url FROM pages")
def thumbnail_choice(t):
    return t.pages.select("page_id", F.coalesce(F.when(c("page_id") % 3 == 0, "maxres"), F.when(c("page_id") % 2 == 0, "sd"), F.lit("default")).alias("url"))


@query("thumbnail_map", f"SELECT page_id, concat('https://img.youtube.com/vi/', {_VID}, '/hqdefault.jpg') AS high FROM pages")
def thumbnail_map(t):
    return t.pages.select("page_id", T.thumbnail_map(F.expr(_VID))["high"].alias("high"))


@query("split_ingredient_text", """
SELECT conv_id, turn, CASE WHEN contains(text, ',') THEN list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> '')
WHEN contains(text, chr(10)) THEN list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') ELSE [trim(text, ' ')] END AS items
FROM conversations
""")
def split_ingredient_text(t):
    return t.conversations.select("conv_id", "turn", T.split_ingredients(c("text")).alias("items"))


@query("chunk_lines", "SELECT doc_id, length(text) AS n FROM documents")
def chunk_lines(t):
    chunks = t.documents.select("doc_id", T.chunk_lines(c("text"), 2000).alias("c"))
    return chunks.select("doc_id", F.length(F.array_join("c", "\n")).cast("long").alias("n"))


@query("extract_json_block", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def extract_json_block(t):
    return t.events.select("event_id", F.from_json(T.extract_json_block(F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```"))), "array<struct<k:int>>")[0]["k"].alias("k"))


@query("normalize_phone", "SELECT c_custkey, concat('+91', 9000000000 + c_custkey) AS phone FROM customer")
def normalize_phone(t):
    return t.customer.select("c_custkey", T.normalize_phone(F.concat(F.when(c("c_custkey") % 3 == 0, "+91 ").when(c("c_custkey") % 3 == 1, "91-").otherwise("0"), (c("c_custkey") + 9000000000).cast("string"))).alias("phone"))


@query("heat_for_matching", "SELECT user_id, CASE WHEN household = 'joint_family' AND heat > 2 THEN heat - 1 ELSE heat END AS heat FROM profiles")
def heat_for_matching(t):
    return t.profiles.select("user_id", F.when((c("household") == "joint_family") & (c("heat") > 2), c("heat") - 1).otherwise(c("heat")).alias("heat"))


@query("affinity_seed", """
SELECT user_id, CASE WHEN region_1 = 'Brand#1' OR region_2 = 'Brand#1' THEN 0.9 WHEN is_dairy_free THEN 0.7 ELSE 0.3 END AS affinity
FROM profiles
""")
def affinity_seed(t):
    return t.profiles.select("user_id", T.affinity_seed(F.array(F.lit("Brand#1"), F.lit("Brand#2")), F.array("region_1", "region_2"), c("is_dairy_free"))["Brand#1"]["affinity"].alias("affinity"))


@query("parse_piped_record", "SELECT s_suppkey AS videos, s_name AS name FROM supplier")
def parse_piped_record(t):
    line = F.split(F.concat_ws("|", "s_name", F.lit("id"), "s_suppkey", F.lit("0.5")), r"\|")
    return t.supplier.select(line[2].cast("long").alias("videos"), line[0].alias("name"))


@query("render_recipe_text", """
SELECT r.recipe_id, concat(title, chr(10), string_agg(standard_name, chr(10) ORDER BY line, standard_name) FILTER (WHERE k <= 3), CASE WHEN max(k) > 3 THEN concat(chr(10), '... and ', max(k) - 3, ' more')
ELSE '' END) AS text FROM recipes r JOIN (SELECT recipe_id, line, standard_name, row_number() OVER (PARTITION BY recipe_id ORDER BY line, standard_name) AS k
FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id) x ON x.recipe_id = r.recipe_id GROUP BY r.recipe_id, title
""")
def render_recipe_text(t):
    full = J.nested(t.recipes.select("recipe_id", "title"), {"i": (t.ingredients.join(t.master, "ingredient_id"), ["line", "standard_name"])}, "recipe_id").where(F.size("i") > 0)
    more = F.when(F.size("i") > 3, F.concat(F.lit("\n... and "), F.size("i") - 3, F.lit(" more"))).otherwise("")
    return full.select("recipe_id", F.concat("title", F.lit("\n"), F.array_join(F.transform(F.slice("i", 1, 3), lambda x: x["standard_name"]), "\n"), more).alias("text"))


@query("first_json_key", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS v FROM events")
def first_json_key(t):
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.step_1.k"), F.get_json_object("props", "$.k")).alias("v"))
