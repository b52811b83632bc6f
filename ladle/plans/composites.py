"""Queries over similarity, search, recommendation, extraction, learning and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.functions import text as T
from ladle.operators import extract as X
from ladle.operators import filters as P
from ladle.operators import joins as J
from ladle.operators import learning as L
from ladle.operators import quality as Q
from ladle.operators import ranking as R
from ladle.operators import similarity as M
from ladle.plans.registry import AS_OF, as_of, query
from ladle.sources import tables as S
from ladle.sources.scratch import scratch_path, written
from ladle.streaming import streams as St

c = F.col

# --- similarity ------------------------------------------------------------------------------


def _titles(t) -> DataFrame:
    return t.part.select(c("p_partkey").alias("recipe_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"))


_TITLES = "d AS (SELECT t, min(id) AS id FROM (SELECT p_partkey AS id, concat(p_name, ' ', lower(p_type)) AS t FROM part) GROUP BY 1), title AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) AS score FROM d x JOIN d y ON x.t < y.t WHERE 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.85)"


@query("self_join_title_sim", f"WITH {_TITLES} SELECT a, b, round(score, 6) AS score FROM title")
def self_join_title_sim(t):
    """Pairs of classes of equal titles; title_classes tells the members."""
    return M.similar_titles(_titles(t)).select("a", "b", F.round("score", 6).alias("score"))


@query("title_classes", "SELECT p_partkey AS recipe_id, min(p_partkey) OVER (PARTITION BY concat(p_name, ' ', lower(p_type))) AS class_id FROM part")
def title_classes(t):
    return M.title_classes(_titles(t)).select("recipe_id", "class_id")


def _item_sets(t) -> DataFrame:
    return t.ingredients.select(c("recipe_id").alias("id"), (c("ingredient_id") % 40).alias("item"))


# Items are below 40, so a set is a bit mask on the other side.
_SETS = """s AS (SELECT recipe_id AS id, bit_or(CAST(1 AS BIGINT) << CAST(ingredient_id % 40 AS INT)) AS m FROM ingredients GROUP BY 1), g AS (SELECT m, min(id) AS id FROM s GROUP BY 1),
sets AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST(bit_count(x.m & y.m) AS DOUBLE) / bit_count(x.m | y.m) AS score FROM g x JOIN g y ON x.m < y.m WHERE bit_count(x.m & y.m) * 10 >= 7 * CAST(bit_count(x.m | y.m) AS INT))"""


@query("self_join_jaccard", f"WITH {_SETS} SELECT a, b, round(score, 6) AS score FROM sets")
def self_join_jaccard(t):
    """Pairs of classes of equal sets; ingredient_classes tells the members."""
    return M.similar_sets(_item_sets(t), 0.7).select("a", "b", F.round("score", 6).alias("score"))


@query("ingredient_classes", f"WITH {_SETS} SELECT s.id, g.id AS class_id FROM s JOIN g ON g.m = s.m")
def ingredient_classes(t):
    return M.set_classes(_item_sets(t)).select("id", "class_id")


def _vec(t) -> DataFrame:
    return t.embeddings.select(c("vec_id").alias("id"), c("embedding").alias("vector"), "label")


def _asked(t) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 20."""
    return _vec(t).where("id % 20 = 0").withColumnRenamed("id", "query_id")


_COS = "list_cosine_similarity(CAST({0}.embedding AS DOUBLE[]), CAST({1}.embedding AS DOUBLE[]))"
_TOP = f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS.format('q', 'v')} AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)"


@query("vector_search", f"SELECT query_id, id, round(score, 6) AS score FROM ({_TOP}) WHERE r <= 10 AND score >= 0.1")
def vector_search(t):
    return M.top_matches(_asked(t), _vec(t), 10, 0.1).select("query_id", "id", F.round("score", 6).alias("score"))


@query("vector_search_filtered", f"""
SELECT query_id, id, round(score, 6) AS score FROM ({_TOP.replace('v.vec_id <> q.vec_id', 'v.vec_id <> q.vec_id AND v.label = q.label')})
WHERE r <= 10 AND score >= 0.1
""")
def vector_search_filtered(t):
    """Only vectors with the query's label."""
    return M.top_matches(_asked(t), _vec(t), 10, 0.1, same=("label",)).select("query_id", "id", F.round("score", 6).alias("score"))


_NEAR = f"cos AS (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM ({_TOP}) WHERE r <= 100 AND score >= 0.3 GROUP BY 1, 2)"


def _near(t) -> DataFrame:
    hits = M.top_matches(_asked(t), _vec(t), 100, 0.3)
    return hits.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("score").alias("score"))


@query("self_join_cosine", f"WITH {_NEAR} SELECT a, b, round(score, 6) AS score FROM cos")
def self_join_cosine(t):
    return _near(t).select("a", "b", F.round("score", 6).alias("score"))


@query("similarity_matrix", f"""
SELECT a.vec_id AS i, b.vec_id AS j, round({_COS.format('a', 'b')}, 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 = 0
""")
def similarity_matrix(t):
    """All similarities within the query set, which is the matrix that was asked for."""
    return M.all_cosines(_asked(t).select(c("query_id").alias("id"), "vector")).select("i", "j", F.round("cos", 6).alias("cos"))


_MEMBERS = """mt AS (SELECT x.p_partkey AS id, d.id AS c FROM part x JOIN d ON d.t = concat(x.p_name, ' ', lower(x.p_type))), ms AS (SELECT s.id, g.id AS c FROM s JOIN g ON g.m = s.m)"""
_EDGES = f"""{_TITLES}, {_SETS}, {_NEAR}, {_MEMBERS}, e AS (SELECT a, b, 'title_fuzzy' AS method, score FROM title UNION ALL SELECT c, id, 'title_fuzzy', 1 FROM mt WHERE id <> c
UNION ALL SELECT a, b, 'ingredients', score FROM sets UNION ALL SELECT c, id, 'ingredients', 1 FROM ms WHERE id <> c UNION ALL SELECT a, b, 'embedding', score FROM cos)"""
# Every pair of members, one by one.
_BEST = f"""{_TITLES}, {_SETS}, {_NEAR}, {_MEMBERS}, te AS (SELECT a, b, score FROM title UNION ALL SELECT b, a, score FROM title UNION ALL SELECT DISTINCT c, c, 1 FROM mt),
se AS (SELECT a, b, score FROM sets UNION ALL SELECT b, a, score FROM sets UNION ALL SELECT DISTINCT c, c, 1 FROM ms),
y AS (SELECT x.id, y.id AS other, 0.4 * e.score AS score FROM mt x JOIN te e ON e.a = x.c JOIN mt y ON y.c = e.b WHERE x.id <> y.id
UNION ALL SELECT x.id, y.id, 0.3 * e.score FROM ms x JOIN se e ON e.a = x.c JOIN ms y ON y.c = e.b WHERE x.id <> y.id UNION ALL SELECT a, b, 0.3 * score FROM cos UNION ALL SELECT b, a, 0.3 * score FROM cos),
w AS (SELECT id, other, round(sum(CAST(score AS DOUBLE)), 9) AS score FROM y GROUP BY 1, 2), best AS (SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS r FROM w) WHERE r = 1 AND score >= 0.3)"""
#: How much each kind of similarity counts.
WEIGHTS = {"title_fuzzy": 0.4, "ingredients": 0.3, "embedding": 0.3}


@query("all_similarities", f"WITH {_EDGES} SELECT a, b, method, round(score, 6) AS score FROM e")
def all_similarities(t):
    """Links of classes, and each class's smallest id with every other member at 1."""
    titles, sets = _titles(t), _item_sets(t)
    kinds = [("title_fuzzy", M.similar_titles(titles)), ("title_fuzzy", M.star(M.title_classes(titles), "recipe_id")), ("ingredients", M.similar_sets(sets, 0.7)), ("ingredients", M.star(M.set_classes(sets), "id")), ("embedding", _near(t))]
    every = None
    for method, df in kinds:
        df = df.select("a", "b", F.lit(method).alias("method"), "score")
        every = df if every is None else every.union(df)
    return J.symmetric_pairs(every.withColumn("computed_at", as_of())).select("a", "b", "method", F.round("score", 6).alias("score"))


def _best(t) -> DataFrame:
    """Best matches of all members. The tables' likenesses have little in common, so that the bound is lower than the usual 0.85."""
    titles, sets = _titles(t), _item_sets(t)
    by_title = M.title_classes(titles).select(c("recipe_id").alias("id"), "class_id")
    classes, near = written(M.set_classes(sets)), written(_near(t))
    set_links = M.useful_set_links(classes, by_title, near, WEIGHTS, 0.3)
    return M.best_matches(by_title, M.similar_titles(titles), classes.select("id", "class_id"), set_links, near, WEIGHTS, 0.3)


@query("combined_similarity", f"WITH {_BEST} SELECT id, other, round(score, 6) AS score FROM best")
def combined_similarity(t):
    return _best(t).select("id", "other", F.round("score", 6).alias("score"))


@query("cluster_recipes", f"""
WITH RECURSIVE {_BEST}, l AS (SELECT id AS a, other AS b FROM best UNION SELECT other, id FROM best), reached AS (SELECT a AS id, a AS m
FROM l UNION SELECT l.b, reached.m FROM reached JOIN l ON l.a = reached.id) SELECT id, min(m) AS component FROM reached GROUP BY 1
""")
def cluster_recipes(t):
    """Components of best matches; those of odd ids come later and are merged into the stored labels of the first."""
    links = written(_best(t).select(c("id").alias("a"), c("other").alias("b")))
    stored = M.components(links.where("a % 2 = 0"))
    return M.merge_components(stored, links.where("a % 2 = 1"))


@query("fuzzy_lookup_join")
def fuzzy_lookup_join(t):
    return M.fuzzy_lookup(t.part.select(F.concat("p_name", F.when(c("p_partkey") % 3 == 0, "s").otherwise("")).alias("item")).distinct(), t.master)


# --- search ----------------------------------------------------------------------------------


@query("hybrid_search", f"""WITH v AS (SELECT query_id, id AS recipe_id, score FROM ({_TOP}) WHERE score >= 0.05), k AS (SELECT query_id, recipe_id, max(score) AS score FROM v WHERE recipe_id IN (SELECT recipe_id FROM tags WHERE dimension = 'spice' AND tag_value IN ('spice_1', 'spice_2')) AND recipe_id IN (SELECT recipe_id FROM recipes WHERE total_time_minutes <= 90 AND meal_slot <> 'snack') GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recipe_id) AS r FROM k)
SELECT query_id, recipe_id, CAST(r AS INT) AS rank, round(score, 3) AS score, concat('similarity ', CAST(CAST(floor(score * 100) AS INT) AS STRING), '%, meets all filters') AS match_reason FROM z WHERE r > 5 AND r <= 10""")
def hybrid_search(t):
    """The second page of five: filters first, then the nearest."""
    suits = J.all_tags(t.recipes.where(P.in_range("total_time_minutes", most=90) & (c("meal_slot") != "snack")).select("recipe_id"), t.tags, {"spice": ["spice_1", "spice_2"]})
    found = _vec(t).join(suits.select(c("recipe_id").alias("id")), "id", "left_semi")
    return M.search_page(_asked(t), found, 5, 5, 0.05).select("query_id", c("id").alias("recipe_id"), "rank", F.round("score", 3).alias("score"), "match_reason")


# --- learning and onboarding -----------------------------------------------------------------

_TESTS = ["perfect_match", "polarizing_ingredient", "texture_fermentation", "regional_boundary", "wildcard_complexity"]
_FOUND = """CASE WHEN k = 0 AND action = 'long_press_left' THEN 'perfect_match_rejection=1.0' WHEN k = 1 AND action = 'long_press_left' THEN 'polarizing_ingredient_rejected=1.0' WHEN k = 1 AND action = 'right' THEN 'polarizing_ingredient_affinity=0.7'
WHEN k = 2 AND action = 'right' THEN 'texture_affinity=0.7' WHEN k = 3 AND action = 'right' THEN 'regional_openness=0.7' WHEN k = 4 AND action = 'right' THEN 'experimentation_factor=0.6' END"""


@query("discover_preferences", f"""
SELECT user_id, list_sort(list(DISTINCT f)) AS found FROM (SELECT user_id, {_FOUND} AS f FROM (SELECT user_id, action, swipe_id % 5 AS k
FROM swipes)) WHERE f IS NOT NULL GROUP BY 1
""")
def discover_preferences(t):
    """Swipes of validation dishes; the test is told by the swipe's number."""
    return _discovered(t).select("user_id", F.array_sort(F.transform(F.map_entries("found"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("found"))


def _discovered(t):
    kind = F.element_at(F.array(*map(F.lit, _TESTS)), (c("swipe_id") % 5 + 1).cast("int"))
    action = F.when(c("action") == "long_press_left", F.when(kind == "perfect_match", "left").otherwise("long_press_left")).otherwise(c("action"))
    return L.discovered_preferences(t.swipes.select("user_id", "swiped_at", "swipe_id", action.alias("action"), kind.alias("test_type")))


@query("refine_profiles", f"""WITH recent AS (SELECT * FROM swipes WHERE swiped_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY), cooked AS (SELECT * FROM cooks WHERE cooked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY),
a AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE spice_feedback = 'too_spicy') * 2 > count(*) THEN -1 WHEN count(*) FILTER (WHERE spice_feedback = 'too_mild') * 2 > count(*) THEN 1 ELSE 0 END AS adjustment FROM cooked GROUP BY 1 HAVING count(*) >= 3),
e AS (SELECT user_id, recipe_id, CASE action WHEN 'right' THEN 0.2 WHEN 'long_press_left' THEN -0.5 ELSE -0.05 END AS s FROM recent UNION ALL SELECT user_id, recipe_id, CASE WHEN would_make_again THEN 0.7 ELSE 0.4 END FROM cooked),
f AS (SELECT user_id, tag_value, round(greatest(0, least(1, 0.5 + sum(CAST(s AS DOUBLE)))), 6) AS affinity FROM e JOIN (SELECT DISTINCT recipe_id, tag_value FROM tags WHERE dimension = 'region') t ON t.recipe_id = e.recipe_id GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT user_id, count(*) AS n_regions, arg_min(tag_value, {{'a': -affinity, 't': tag_value}}) AS best_region FROM f GROUP BY 1),
b AS (SELECT user_id, recipe_id, action, sum(CASE WHEN action <> 'right' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY swiped_at, swipe_id) AS run FROM recent),
w AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last, count(*) FILTER (WHERE action = 'right') OVER (PARTITION BY user_id, run) AS n FROM b),
l AS (SELECT user_id, dimension, tag_value, w.n, count(*) AS hits FROM w JOIN (SELECT DISTINCT recipe_id, dimension, tag_value FROM tags) t ON t.recipe_id = w.recipe_id WHERE action = 'right' AND run < last AND w.n >= 3 GROUP BY user_id, run, dimension, tag_value, w.n),
d AS (SELECT user_id, string_agg(DISTINCT concat(dimension, '_preference'), ',' ORDER BY concat(dimension, '_preference')) AS discovered FROM l WHERE hits >= 0.5 * n GROUP BY 1),
n AS (SELECT user_id, least(0.85 + least(0.001 * sum(n) + 0.01 * sum(k), 0.10), 0.95) AS learned FROM (SELECT user_id, 1 AS n, 0 AS k FROM swipes UNION ALL SELECT user_id, 0, 1 FROM cooks) GROUP BY 1)
SELECT p.user_id, CAST(greatest(1, least(5, heat + coalesce(adjustment, 0))) AS INT) AS heat, coalesce(n_regions, 0) AS n_regions, best_region, coalesce(discovered, '') AS discovered, round(coalesce(learned, 0.85), 6) AS confidence
FROM profiles p LEFT JOIN a ON a.user_id = p.user_id LEFT JOIN g ON g.user_id = p.user_id LEFT JOIN d ON d.user_id = p.user_id LEFT JOIN n ON n.user_id = p.user_id""")
def refine_profiles(t):
    """Profiles after what the users did in two weeks: heat, regions and the one that they like best, what runs of likes have in common, and how sure the profile is."""
    refined = L.refined_profiles(t.profiles, t.swipes, t.cooks, t.tags, as_of())
    best = F.array_min(F.transform(F.map_entries("regions"), lambda e: F.struct((-F.round(e["value"]["affinity"], 6)).alias("a"), e["key"].alias("t"))))["t"]
    names = F.array_join(F.array_sort(F.map_keys("discovered")), ",")
    return refined.select("user_id", "heat", F.coalesce(F.size(F.map_keys("regions")), F.lit(0)).cast("long").alias("n_regions"), best.alias("best_region"), F.coalesce(names, F.lit("")).alias("discovered"), F.round("confidence", 6).alias("confidence"))


@query("profile_documents", """
SELECT user_id, CAST(to_json({'constraints': {'diet': diet, 'allium': allium_status, 'dairy_free': is_dairy_free, 'prohibitions': CASE WHEN prohibition IS NULL THEN []
ELSE [prohibition] END}, 'preferences': {'heat': heat, 'regions': [region_1, region_2], 'gravy': gravy, 'flavour': flavour}, 'context': {'household': household, 'weekday_minutes': time_budget}}) AS VARCHAR) AS doc
FROM profiles
""")
def profile_documents(t):
    constraints = F.struct("diet", c("allium_status").alias("allium"), c("is_dairy_free").alias("dairy_free"), F.array_compact(F.array("prohibition")).alias("prohibitions"))
    preferences = F.struct("heat", F.array("region_1", "region_2").alias("regions"), "gravy", "flavour")
    context = F.struct("household", c("time_budget").alias("weekday_minutes"))
    return t.profiles.select("user_id", F.to_json(F.struct(constraints.alias("constraints"), preferences.alias("preferences"), context.alias("context"))).alias("doc"))


_DECISION = "CASE feedback_id % 4 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' ELSE 'unknown' END"


@query("feedback_review", f"""
SELECT feedback_id, CASE WHEN {_DECISION} = 'unknown' THEN status ELSE {_DECISION} END AS status, {_DECISION} <> 'unknown' AS accepted
FROM feedback WHERE status = 'pending'
""")
def feedback_review(t):
    """Decisions on pending feedback; unknown ones are not accepted and change nothing."""
    pending = t.feedback.where("status = 'pending'")
    decisions = pending.select("feedback_id", F.expr(_DECISION).alias("decision"))
    accepted = c("decision").isin("reviewed", "applied", "rejected")
    both = pending.join(decisions, "feedback_id").withColumn("accepted", accepted)
    return S.mark(both, c("accepted"), status=c("decision")).select("feedback_id", "status", "accepted")


_SESSIONS = f"""k AS (SELECT user_id, recipe_id % 8 + 1 AS step, max({{'at': swiped_at, 'id': swipe_id}}) AS x, arg_max(CASE WHEN action <> 'view' THEN action ELSE '' END, {{'at': swiped_at, 'id': swipe_id}}) AS answer FROM swipes GROUP BY 1, 2),
d AS (SELECT user_id, count(DISTINCT f) AS d FROM (SELECT user_id, {_FOUND} AS f FROM (SELECT user_id, action, swipe_id % 5 AS k FROM swipes)) WHERE f IS NOT NULL GROUP BY 1),
m AS (SELECT user_id, count(*) AS steps, arg_max(step, x) + 1 AS current_step, count(*) = 8 AS completed, sum(CASE WHEN answer <> '' THEN CASE WHEN step IN (2, 3, 8) THEN 1 WHEN step IN (4, 5, 6) THEN 2 ELSE 0 END ELSE 0 END) AS filled FROM k GROUP BY 1),
sessions AS (SELECT m.user_id, steps, CAST(current_step AS INT) AS current_step, completed, CASE WHEN completed THEN (filled + CAST(coalesce(d, 0) > 0 AS INT)) / 10 END AS completeness,
  CASE WHEN completed THEN round((8 * 0.95 + coalesce(d, 0) * 0.6) / (8 + coalesce(d, 0)), 6) END AS confidence FROM m LEFT JOIN d ON d.user_id = m.user_id)"""


def _sessions(t):
    """Swipes stand for submissions: the recipe tells the step, the action is the answer, and a mere view leaves the step empty."""
    answer = F.when(c("action") != "view", c("action"))
    submitted = t.swipes.select("user_id", (c("recipe_id") % 8 + 1).cast("int").alias("step"), answer.alias("answer"), c("swiped_at").alias("at"), c("swipe_id").alias("id"))
    return L.onboarding_sessions(submitted, _discovered(t))


@query("onboarding_progress", f"""
WITH {_SESSIONS} SELECT p.user_id, CASE WHEN completed THEN 'completed' WHEN completed IS NOT NULL THEN 'in_progress' ELSE 'not_started' END AS status,
CASE WHEN NOT completed THEN current_step / 8 * 100 END AS percent FROM profiles p LEFT JOIN sessions s ON s.user_id = p.user_id
""")
def onboarding_progress(t):
    return L.onboarding_status(t.profiles, _sessions(t))


@query("explode_tag_proposals", """WITH p AS (SELECT user_id * 20 AS recipe_id, diet, [region_1, region_2] AS region, allium_status = 'both' AS allium, ['lunch', 'dinner'] AS meal FROM profiles WHERE user_id * 20 IN (SELECT recipe_id FROM recipes))
SELECT recipe_id, 'diet' AS dimension, diet AS tag_value, 0.9 AS confidence FROM p UNION ALL SELECT recipe_id, 'region', unnest(region), 0.85 FROM p UNION ALL SELECT recipe_id, 'allium', CAST(allium AS VARCHAR), 0.95 FROM p UNION ALL SELECT recipe_id, 'meal', unnest(meal), 0.8 FROM p""")
def explode_tag_proposals(t):
    """Proposals of a recipe as one struct; those of unknown recipes go."""
    proposals = t.profiles.select((c("user_id") * 20).alias("recipe_id"), "diet", F.array("region_1", "region_2").alias("region"), (c("allium_status") == "both").alias("allium"), F.array(F.lit("lunch"), F.lit("dinner")).alias("meal"))
    return Q.proposed_tags(proposals, t.recipes.select("recipe_id"))


@query("ingest_feedback", """
SELECT feedback_id, type, CASE type WHEN 'rating' THEN CAST(rating AS VARCHAR) WHEN 'correction' THEN 'field title' ELSE 'report' END AS detail, f.recipe_id IN
(SELECT recipe_id FROM recipes WHERE platform <> 'F') AND (type <> 'rating' OR rating BETWEEN 1 AND 5) AS accepted
FROM feedback f
""")
def ingest_feedback(t):
    """Ratings, corrections and reports as one table; rows of unknown recipes and ratings out of range aren't accepted."""
    ratings = t.feedback.where("type = 'rating'").select("feedback_id", "recipe_id", "type", "rating", c("rating").cast("string").alias("detail"))
    corrections = t.feedback.where("type = 'correction'").select("feedback_id", "recipe_id", "type", F.lit("field title").alias("detail"))
    reports = t.feedback.where("type = 'report'").select("feedback_id", "recipe_id", "type", F.lit("report").alias("detail"))
    every = ratings.unionByName(corrections, allowMissingColumns=True).unionByName(reports, allowMissingColumns=True)
    known = t.recipes.where("platform <> 'F'").select("recipe_id", F.lit(True).alias("known"))
    accepted = c("known").isNotNull() & F.coalesce(c("rating").between(1, 5), F.lit(True))
    return every.join(known, "recipe_id", "left").select("feedback_id", "type", "detail", accepted.alias("accepted"))


_CHUNK = 2000


@query("ingest_book_recipes", f"""
WITH RECURSIVE l AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, 1 AS i, length(ls[1]) AS size, 1 AS start FROM l UNION ALL SELECT w.doc_id, i + 1,
  CASE WHEN size + length(ls[i + 1]) + 1 <= {_CHUNK} THEN size + length(ls[i + 1]) + 1 ELSE length(ls[i + 1]) END, CASE WHEN size + length(ls[i + 1]) + 1 <= {_CHUNK} THEN start ELSE i + 1 END FROM w JOIN l ON l.doc_id = w.doc_id WHERE i < len(ls)),
u AS (SELECT w.doc_id, source, concat('pdf://', source, '#', left(ls[i], 10)) AS url FROM w JOIN l ON l.doc_id = w.doc_id WHERE i = start),
o AS (SELECT DISTINCT url FROM u WHERE doc_id % 2 = 0)
SELECT source AS file, count(*) AS recipes, count(DISTINCT url) FILTER (WHERE url NOT IN (SELECT url FROM o)) AS saved, count(*) - count(DISTINCT url) FILTER (WHERE url NOT IN (SELECT url FROM o)) AS skipped FROM u GROUP BY 1
""")
def ingest_book_recipes(t):
    """Chunks of books (documents of a source), for which the answer to each names its first line as a recipe; half the books were taken in before."""
    chunks = X.book_chunks(t.documents.select(c("source").alias("file"), "doc_id", "text"), _CHUNK)
    title = F.substring(F.substring_index("chunk", "\n", 1), 1, 10)
    answers = chunks.withColumn("answer", F.concat(F.lit("Here they are:\n```json\n"), F.to_json(F.array(F.struct(title.alias("title")))), F.lit("\n```")))
    before = X.book_recipes(answers.where("doc_id % 2 = 0"), t.pages.where("false").select("url"))
    return X.book_report(X.book_recipes(answers, before.where("saved").select("url")))


_HAVE = "(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"


@query("embedding_audit", f"""
SELECT count(*) FILTER (WHERE vec_id IN {_HAVE}) AS valid, count(*) FILTER (WHERE vec_id NOT IN {_HAVE}) AS orphaned, (SELECT count(*)
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT vec_id FROM embeddings)) AS missing, 0 AS surplus
FROM embeddings
""")
def embedding_audit(t):
    recipes = t.orders.where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("recipe_id"))
    return Q.embedding_audit(t.embeddings.select(c("vec_id").alias("point_id"), c("vec_id").alias("recipe_id")), recipes)


def _checked(t) -> DataFrame:
    """Recipes in the shape that validation looks at; steps and times are made of the numbers that recipes have."""
    amount = c("quantity") * F.when(c("unit") == "kg", 1000.0).otherwise(1.0)
    lines = t.ingredients.join(t.master, "ingredient_id").select("recipe_id", F.struct("line", c("standard_name").alias("name"), amount.alias("quantity")).alias("i"))
    items = lines.groupBy("recipe_id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"))).alias("ingredients"))
    steps = F.transform(F.sequence(F.lit(1), "servings"), lambda i: F.concat(F.lit("Step "), i.cast("string"), F.when(i % 2 == 0, " of the dish").otherwise("")))
    return t.recipes.join(items, "recipe_id", "left").withColumns({"creator": c("creator_id").cast("string"), "steps": steps, "prep": c("total_time_minutes") % 50, "cook": c("total_time_minutes") % 70, "total": c("total_time_minutes")})


_ISSUES = """WITH l AS (SELECT i.recipe_id, row_number() OVER (PARTITION BY i.recipe_id ORDER BY line, standard_name, quantity * CASE unit WHEN 'kg' THEN 1000 ELSE 1 END) - 1 AS k, quantity * CASE unit WHEN 'kg' THEN 1000 ELSE 1 END AS q FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id),
n AS (SELECT recipe_id, count(*) AS n FROM l GROUP BY 1), r AS (SELECT r.*, coalesce(n, 0) AS n, total_time_minutes AS t FROM recipes r LEFT JOIN n ON n.recipe_id = r.recipe_id),
issues AS (SELECT recipe_id, 'description' AS field, 'WARNING' AS severity FROM r WHERE length(description) < 20 UNION ALL SELECT recipe_id, 'ingredients', CASE n WHEN 0 THEN 'ERROR' ELSE 'WARNING' END FROM r WHERE n < 2 UNION ALL SELECT recipe_id, 'instructions', 'WARNING' FROM r WHERE servings = 1
  UNION ALL SELECT recipe_id, 'total', 'WARNING' FROM r WHERE t % 50 > 0 AND t % 70 > 0 AND t < t % 50 + t % 70 UNION ALL SELECT recipe_id, concat('ingredients[', k, '].quantity'), 'WARNING' FROM l WHERE q > 10000
  UNION ALL SELECT recipe_id, concat('instructions[', i - 1, ']'), 'WARNING' FROM (SELECT recipe_id, unnest(range(1, servings + 1)) AS i FROM r) WHERE i % 2 = 1)"""


@query("validate_recipes", f"{_ISSUES} SELECT * FROM issues")
def validate_recipes(t):
    return Q.validation_issues(_checked(t)).select("recipe_id", "field", "severity")


@query("validation_summary", f"""
{_ISSUES} SELECT r.recipe_id, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER
(WHERE severity = 'ERROR') = 0 AS is_valid FROM r LEFT JOIN issues i ON i.recipe_id = r.recipe_id GROUP BY 1
""")
def validation_summary(t):
    return Q.validation_summary(t.recipes, Q.validation_issues(_checked(t)))


@query("tag_quality_report", """
WITH k AS (SELECT *, dimension = 'region' OR (dimension = 'texture' AND tag_value IN ('SMALL', 'LARGE', 'PROMO')) OR (dimension = 'spice' AND tag_value IN
('spice_1', 'spice_2', 'spice_3')) AS ok FROM tags) SELECT recipe_id, count(*) AS total, count(*) FILTER (WHERE ok AND confidence >= 0.95) AS kept, count(*) FILTER
(WHERE NOT ok OR confidence < 0.95) AS filtered, count(DISTINCT dimension) FILTER (WHERE ok AND confidence >= 0.95 AND dimension <> 'spice') = 2 AS is_valid
FROM k GROUP BY 1
""")
def tag_quality_report(t):
    allowed = t.spark.sql("SELECT * FROM VALUES ('texture', array('SMALL', 'LARGE', 'PROMO'), true), ('spice', array('spice_1', 'spice_2', 'spice_3'), false), ('region', CAST(NULL AS ARRAY<STRING>), true) AS (dimension, allowed_values, is_required)")
    return Q.tag_report(t.tags, allowed, 0.95)


@query("create_meal_plans", """
SELECT plan_id, user_id, day, plan_id = min(plan_id) OVER (PARTITION BY user_id, day) AS accepted
FROM (SELECT o_orderkey AS plan_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day
FROM orders)
""")
def create_meal_plans(t):
    """One plan a user and day, the first one; the others aren't accepted."""
    plans = t.orders.select(c("o_orderkey").alias("plan_id"), c("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
    first = plans.groupBy("user_id", "day").agg(F.min("plan_id").alias("first"))
    return plans.join(first, ["user_id", "day"]).select("plan_id", "user_id", "day", (c("plan_id") == c("first")).alias("accepted"))


@query("fold_onboarding", f"WITH {_SESSIONS} SELECT * FROM sessions")
def fold_onboarding(t):
    return _sessions(t).select("user_id", F.size("answers").cast("long").alias("steps"), "current_step", "completed", "completeness", F.round("confidence", 6).alias("confidence"))


@query("normalize_parsed_ingredients", """
SELECT item, min(p_partkey) AS ingredient_id, 0.9 AS confidence FROM (SELECT DISTINCT concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' zzzzzzzzzzzzzzzzzzzz'
ELSE '' END) AS item FROM part) JOIN part ON p_name = item GROUP BY 1
""")
def normalize_parsed_ingredients(t):
    items = t.part.select(F.concat("p_name", F.when(c("p_partkey") % 3 == 0, " zzzzzzzzzzzzzzzzzzzz").otherwise("")).alias("item")).distinct()
    return M.fuzzy_lookup(items, t.master).where("ingredient_id IS NOT NULL").select("item", "ingredient_id", F.lit(0.9).alias("confidence"))


_LINE_NAME = "array_to_string(list_transform(string_split(standard_name, ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ')"


@query("normalize_ingredients", f"""
WITH d AS (SELECT standard_name AS n, min(ingredient_id) AS first_id FROM master GROUP BY 1) SELECT i.recipe_id, i.line, {_LINE_NAME} AS item, first_id AS ingredient_id, 0.99 AS confidence
FROM ingredients i JOIN master m ON m.ingredient_id = i.ingredient_id JOIN d ON d.n = standard_name
""")
def normalize_ingredients(t):
    text = F.concat(c("quantity").cast("int"), F.lit(" "), F.when(c("unit") == "g", "grams").otherwise(c("unit")), F.lit(" "), "standard_name")
    lines = t.ingredients.join(t.master, "ingredient_id").select("recipe_id", "line", text.alias("text"))
    lines = T.parsed_lines(lines, "text")
    known = M.fuzzy_lookup(lines.select("item").distinct(), t.master)
    return lines.join(known, "item", "left").select("recipe_id", "line", "item", "ingredient_id", F.when(c("ingredient_id").isNotNull(), 0.99).otherwise(0.75).alias("confidence"))


# --- pages -----------------------------------------------------------------------------------

_LD = '<script type="application/ld+json">{"@graph":[{"@type":"Page"},{"@type":"Recipe","name":"Dish %s","description":"A dish of rice for every day","recipeIngredient":["2 cups rice","1 tablespoon oil"],"recipeInstructions":[{"@type":"HowToStep","text":"Boil the rice for 20 minutes"},{"@type":"HowToStep","text":"Serve it while it is hot"}],"totalTime":"PT1H5M"}]}</script><meta property="og:image" content="/og.jpg">'
_MANUAL = '<h2 class="recipe-title">Manual %s</h2><ul class="ingredients"><li>3 grams salt</li><li>2 cups <b>flour</b></li></ul><ol class="instructions"><li>Mix all of it well for 10 min</li></ol><div class="content"><img src="/a.png" alt="plain"><img src="/d.png" alt="A dish"></div>'
_BARE = '<h2 class="heading">Bare %s</h2><img src="/logo.png"><img src="/first.png">'


def _pages(t) -> DataFrame:
    """The given pages, of which three quarters carry a recipe: as structured data, as marked lists, or as a bare title."""
    kind = c("page_id") % 4
    marks = F.when(kind == 0, F.format_string(_LD.replace("%", "%%").replace("%%s", "%s"), c("page_id").cast("string"))).when(kind == 1, F.format_string(_MANUAL, c("page_id").cast("string"))).when(kind == 2, F.format_string(_BARE, c("page_id").cast("string"))).otherwise("")
    return t.pages.withColumn("html", F.concat("html", marks))


_TITLE = "CASE page_id % 4 WHEN 0 THEN concat('Dish ', page_id) WHEN 1 THEN concat('Manual ', page_id) WHEN 2 THEN concat('Bare ', page_id) END"
_HOST = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_FIRST = "pages p WHERE page_id = (SELECT min(page_id) FROM pages q WHERE q.url = p.url)"


@query("extract_jsonld_recipes", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat('Dish ', page_id) END AS name FROM pages")
def extract_jsonld_recipes(t):
    return _pages(t).select("page_id", F.get_json_object(X.jsonld_recipe(c("html")), "$.name").alias("name"))


@query("extract_dom_fallback", """
SELECT page_id, CASE WHEN page_id % 4 IN (1, 2) THEN concat(CASE page_id % 4 WHEN 1 THEN 'Manual ' ELSE 'Bare ' END, page_id) END AS title, CASE
WHEN page_id % 4 = 1 THEN ['3 grams salt', '2 cups flour'] ELSE [] END AS items, CASE WHEN page_id % 4 = 1 THEN ['Mix all of it well for 10 min']
ELSE [] END AS steps FROM pages
""")
def extract_dom_fallback(t):
    return _pages(t).select("page_id", X.dom_title(c("html")).alias("title"), X.dom_items(c("html")).alias("items"), X.dom_steps(c("html")).alias("steps"))


@query("extract_main_image", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat({_HOST}, '/og.jpg') WHEN 1 THEN concat({_HOST}, '/d.png') WHEN 2 THEN concat({_HOST}, '/first.png') END AS url, CASE page_id % 4
WHEN 0 THEN 'og_image' WHEN 1 THEN 'content_image' WHEN 2 THEN 'first_image' END AS source
FROM pages
""")
def extract_main_image(t):
    return _pages(t).select("page_id", X.main_image(c("html"), F.lit(None).cast("string"), c("url")).alias("i")).select("page_id", "i.*")


@query("extract_links", f"""
SELECT DISTINCT page_id, concat({_HOST}, l) AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1, 'i')) AS l
FROM pages) WHERE regexp_matches(lower(concat({_HOST}, l)), 'the|de')
""")
def extract_links(t):
    return X.links(t.pages, ["the", "de"])


@query("choose_extraction", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'schema' WHEN 3 THEN CASE WHEN page_id % 3 = 0 THEN 'scrapers' ELSE 'none' END ELSE CASE WHEN page_id % 3 = 0 THEN 'scrapers'
ELSE 'manual' END END AS tier, CASE WHEN page_id % 4 > 0 AND page_id % 3 = 0 THEN 'Scraped' ELSE {_TITLE} END AS title, CAST(CASE WHEN page_id % 4 > 0
AND page_id % 3 = 0 THEN 1 WHEN page_id % 4 IN (0, 1) THEN 2 ELSE 0 END AS INT) AS n FROM pages
""")
def choose_extraction(t):
    """Every third page also has a scraped document."""
    scraped = F.when(c("page_id") % 3 == 0, '{"title":"Scraped","ingredients":["salt"],"instructions":"Cook it well"}')
    return X.choose_extraction(_pages(t).withColumn("scraped", scraped)).select("page_id", "tier", "title", F.size("items").alias("n"))


@query("extract_transcript_doc", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS transcript FROM conversations GROUP BY 1")
def extract_transcript_doc(t):
    return R.ordered_list(t.conversations, "conv_id", ["turn", "text"], "text", "l").select("conv_id", F.array_join("l", "\n").alias("transcript"))


@query("schema_instructions", "SELECT conv_id, turn, CAST(0 AS INT) AS place, text AS step FROM conversations")
def schema_instructions(t):
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("HowToStep").alias("@type"), c("text"))).alias("recipeInstructions")))
    return t.conversations.select("conv_id", "turn", F.posexplode(X.instructions(doc)).alias("place", "step"))


@query("build_recipes", f"""
SELECT page_id AS recipe_id, {_TITLE} AS title, CASE page_id % 4 WHEN 0 THEN 'schema' ELSE 'manual' END AS tier, CAST(CASE page_id % 4 WHEN 0 THEN 65
ELSE 10 END AS INT) AS total_time, 2 AS n_items, CASE page_id % 4 WHEN 0 THEN 2 ELSE 1 END AS n_steps
FROM {_FIRST} AND page_id % 4 < 2 AND url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0)
""")
def build_recipes(t):
    """Recipes with the numbers of their ingredients and steps; every tenth page counts as done."""
    built = X.build_recipes(_pages(t), t.pages.where("page_id % 10 = 0").select("url"))
    counts = [built[name].groupBy("recipe_id").agg(F.count("*").alias(n)) for name, n in (("ingredients", "n_items"), ("steps", "n_steps"))]
    return built["recipes"].join(counts[0], "recipe_id").join(counts[1], "recipe_id")


@query("build_recipes_rejects", f"""
SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'invalid' ELSE 'no title' END AS error FROM {_FIRST} AND page_id % 4 >= 2 AND url NOT IN (SELECT url
FROM pages WHERE page_id % 10 = 0)
""")
def build_recipes_rejects(t):
    return X.build_recipes(_pages(t), t.pages.where("page_id % 10 = 0").select("url"))["rejects"]


@query("update_images", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE url END AS url FROM pages")
def update_images(t):
    return S.partial_update(t.pages.select("page_id", "url"), t.pages.where("page_id % 3 = 0").select("page_id", F.lit("new").alias("url")), "page_id")


# --- streams ---------------------------------------------------------------------------------


@query("stream_ingest_events", "SELECT event_id, user_id, event_type FROM events")
def stream_ingest_events(t):
    return St.run_once(St.ingest(St.read_events(t.spark, t.sf_dir)), "ingest").select("event_id", "user_id", "event_type")


@query("stream_rating_aggregate", """
SELECT recipe_id, count(*) AS total_ratings, round(avg(rating), 6) AS average_rating, count(*) FILTER (WHERE rating = 5) AS rating_5
FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS recipe_id, 1 + CAST(floor(value) AS INT) % 5 AS rating FROM events) GROUP BY 1
""")
def stream_rating_aggregate(t):
    """The events' values stand for stars."""
    rated = St.read_events(t.spark, t.sf_dir).select(F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("recipe_id"), (1 + F.floor("value").cast("int") % 5).alias("rating"))
    total, _ = St.running_ratings(rated)
    return total.select("recipe_id", "total_ratings", F.round(c("stars") / c("total_ratings"), 6).alias("average_rating"), "rating_5")


@query("stream_trending_window", """
SELECT CAST(start AS TIMESTAMP) AS start, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * k AS start, event_type
FROM events, range(7) r(k)) WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY
FROM events) GROUP BY 1, 2
""")
def stream_trending_window(t):
    """Windows that the watermark has closed."""
    return St.run_once(St.trending(St.read_events(t.spark, t.sf_dir)), "trending").withColumn("start", c("start").cast("timestamp_ntz"))


@query("stream_scrape_health", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS ok,
round(count(*) FILTER (WHERE event_type <> 'error') * 100.0 / count(*), 2) AS rate FROM events GROUP BY 1
""")
def stream_scrape_health(t):
    return St.run_once(St.health(St.read_events(t.spark, t.sf_dir)), "health", "complete").withColumn("start", c("start").cast("timestamp_ntz"))


@query("stream_refine_trigger", """
SELECT user_id, CAST(n AS BIGINT) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
FROM events) WHERE n % 10 = 0
""")
def stream_refine_trigger(t):
    return St.run_once(St.refine_triggers(St.read_events(t.spark, t.sf_dir)), "refine")


@query("stream_affinity_state", """
WITH e AS (SELECT user_id, ts, event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS recipe_id, event_type = 'purchase' AS boost,
CASE WHEN event_type = 'purchase' THEN 0.4 + CASE event_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0 ELSE -0.2 END WHEN value >= 3 THEN 0.05 END AS signal FROM events),
d AS (SELECT recipe_id, dimension, arg_max(tag_value, {'id': tag_id, 'value': tag_value}) AS value FROM tags GROUP BY 1, 2),
k AS (SELECT user_id, ts, event_id, boost, signal, CASE WHEN boost AND dimension = 'region' THEN concat('region:', value) ELSE dimension END AS key FROM e JOIN d ON d.recipe_id = e.recipe_id WHERE signal IS NOT NULL),
g AS (SELECT user_id, key, sum(CAST(signal AS DOUBLE)) AS s, count(*) AS n, count(*) FILTER (WHERE boost) AS b, arg_min(boost, {'ts': ts, 'id': event_id}) AS first FROM k GROUP BY 1, 2)
SELECT user_id, key, round(least(1.0, 0.5 + s), 6) AS affinity, n,
round(CASE WHEN contains(key, ':') THEN least(0.95, 0.6 + 0.05 * n) WHEN first THEN least(0.85, 0.5 + 0.05 * (b - 1)) ELSE least(0.85, 0.3 + 0.05 * b) END, 6) AS confidence FROM g
""")
def stream_affinity_state(t):
    """The last state of each user's dimensions and regions."""
    events = St.read_events(t.spark, t.sf_dir)
    cooked = c("event_type") == "purchase"
    again = F.when(c("event_id") % 3 == 0, True).when(c("event_id") % 3 == 2, False)
    shown = events.select("user_id", "ts", "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("recipe_id"), cooked.alias("cooked"), again.alias("again"), c("value").alias("dwell"))
    states = St.run_once(St.affinity_state(St.signals_by_batch(shown, t.tags)), "affinity", "update")
    last = R.latest_per(states, ["user_id", "key"], [F.desc("n")])
    return last.select("user_id", "key", F.round("affinity", 6).alias("affinity"), F.round("confidence", 6).alias("confidence"), "n")


_BATCHES = f"r AS (SELECT page_id AS recipe_id, {_TITLE} AS title, page_id % 4 AS kind FROM {_FIRST} AND page_id % 4 < 2)"


@query("incremental_pipeline", f"""
WITH {_BATCHES}, s AS (SELECT a.recipe_id, count(*) AS n FROM r a JOIN r b ON a.recipe_id <> b.recipe_id WHERE 1 - levenshtein(lower(a.title), lower(b.title)) / greatest(length(a.title), length(b.title)) >= 0.85 GROUP BY 1)
SELECT r.recipe_id, title, CASE kind WHEN 0 THEN 'schema' ELSE 'manual' END AS tier, CAST(CASE kind WHEN 0 THEN 65 ELSE 10 END AS INT) AS total_time,
'true' AS gluten_free, coalesce(n, 0) AS n_similar FROM r LEFT JOIN s ON s.recipe_id = r.recipe_id
""")
def incremental_pipeline(t):
    """Recipes of the pages, which come in two halves, with a tag and the number of similar titles of each."""
    folder = _scratch(t, "incoming")
    half = F.floor(F.lit(t.pages.agg(F.max("page_id")).first()[0] or 0) / 2)
    files = t.spark.sparkContext.defaultParallelism
    for late in (False, True):
        # The second half has as many files as the first one at most, so that each half is a batch.
        _pages(t).where((c("page_id") > half) == late).repartition(files, "page_id").coalesce(files).write.mode("append").parquet(f"{folder}/pages.parquet")
        files = len(t.spark.read.parquet(f"{folder}/pages.parquet").inputFiles()) if not late else files
    out = St.incremental_recipes(t.spark, folder, files=files)
    links = out["similar"].select(c("a").alias("recipe_id")).union(out["similar"].select("b")).groupBy("recipe_id").agg(F.count("*").alias("n"))
    gluten = out["tags"].where("dimension = 'health_gluten_free'").select("recipe_id", c("tag_value").alias("gluten_free"))
    every = out["recipes"].join(gluten, "recipe_id", "left").join(links, "recipe_id", "left")
    return every.select("recipe_id", "title", "tier", "total_time", "gluten_free", F.coalesce("n", F.lit(0)).cast("long").alias("n_similar"))


@query("recipe_quarantine", f"""
SELECT url, page_id, CAST(CASE page_id % 4 WHEN 2 THEN 2 ELSE 3 END AS INT) AS attempts, CASE page_id % 4 WHEN 2 THEN 'invalid' ELSE 'no title' END AS error, page_id % 4 = 3 AS failed FROM {_FIRST} AND page_id % 4 >= 2
""")
def recipe_quarantine(t):
    """Pages that came to nothing, after two runs over all of them."""
    none = t.spark.createDataFrame([], X.QUARANTINE)
    done = t.pages.where("false").select("url")
    first = written(X.build_with_attempts(_pages(t), done, none)["quarantine"])
    return X.build_with_attempts(_pages(t), done, first)["quarantine"]


# --- sinks, read back ------------------------------------------------------------------------


def _scratch(t, name: str) -> str:
    return scratch_path(t.spark, name)


@query("sink_csv_report", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv_report(t):
    path = _scratch(t, "report")
    S.write_csv_report(t.customer.select("c_custkey", "c_name", "c_mktsegment"), path)
    return t.spark.read.option("header", True).schema("c_custkey long, c_name string, c_mktsegment string").csv(path)


@query("sink_url_list", "SELECT DISTINCT url FROM pages")
def sink_url_list(t):
    path = _scratch(t, "urls")
    S.write_url_list(t.pages, path)
    return S.read_url_list(t.spark, path)


@query("append_scrape_error", "SELECT event_id, 'HTTP' AS error_type, concat('error ', props) AS message FROM events WHERE event_type = 'error'")
def append_scrape_error(t):
    path = _scratch(t, "errors")
    S.append_fact(t.events.where("event_type = 'error'").select("event_id", F.lit("HTTP").alias("error_type"), F.concat(F.lit("error "), "props").alias("message"), F.to_date("ts").alias("day")), path, "day")
    return t.spark.read.parquet(path).select("event_id", "error_type", "message")
