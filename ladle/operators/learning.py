"""Affinities, feedback scores and profile measures of all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an action says about a recipe's tags.
SIGNALS = {"right": 0.20, "save": 0.15, "left": -0.05, "view": 0.05, "long_press_left": -0.50, "made_it": 0.40}
AGAIN, NOT_AGAIN = 0.30, -0.20


def signal(action: str, table: dict[str, float] = SIGNALS, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), F.col(action)), F.lit(otherwise))


def rating_aggregate(ratings: DataFrame) -> DataFrame:
    """Count, mean and stars of each recipe."""
    stars = [F.count_if(F.col("rating") == k).alias(f"rating_{k}") for k in range(1, 6)]
    return ratings.where("rating BETWEEN 1 AND 5").groupBy("recipe_id").agg(F.count("*").alias("total_ratings"), (F.sum("rating") / F.count("*")).alias("average_rating"), *stars)


def bayesian_rating(total: Column, mean: Column, weight: float = 10.0, prior: float = 0.7) -> Column:
    """The mean (of 5) drawn to the prior by `weight` votes; 0.5 without ratings."""
    return F.coalesce(F.when(total > 0, total / (total + weight) * mean / 5 + weight / (total + weight) * prior), F.lit(0.5))


def trending(ratings: DataFrame, as_of: Column, days: int, least: int = 4, limit: int = 10) -> DataFrame:
    recent = ratings.where((F.col("created_at") >= as_of - F.make_interval(days=F.lit(days))) & (F.col("rating") >= least))
    return recent.groupBy("recipe_id").agg(F.count("*").alias("n"), F.avg("rating").alias("mean")).orderBy(F.desc("n"), F.desc("mean"), "recipe_id").limit(limit)


def affinity_by_likes(swipes: DataFrame, tags: DataFrame) -> DataFrame:
    """likes / (likes + dislikes) per user and tag value; only right and long_press_left count."""
    seen = swipes.where(F.col("action").isin("right", "long_press_left")).join(tags.select("recipe_id", "tag_value").distinct(), "recipe_id")
    n, likes = F.count("*"), F.count_if(F.col("action") == "right")
    return seen.groupBy("user_id", "tag_value").agg(likes.alias("likes"), n.alias("n"), (likes / n).alias("affinity"), F.least(0.6 + 0.05 * n, F.lit(0.85)).alias("confidence"))


def affinity_by_signals(swipes: DataFrame, cooks: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    """clamp(0.5 + summed signals) per user and tag value with at least `least` interactions."""
    swiped = swipes.select("user_id", "recipe_id", signal("action", {"right": 0.2, "long_press_left": -0.5}, -0.05).alias("s"))
    cooked = cooks.select("user_id", "recipe_id", (0.4 + F.when(F.col("would_make_again"), 0.3).otherwise(0.0)).alias("s"))
    seen = swiped.union(cooked).join(tags.select("recipe_id", "tag_value").distinct(), "recipe_id").groupBy("user_id", "tag_value").agg(F.count("*").alias("n"), F.sum("s").alias("s")).where(F.col("n") >= least)
    return seen.select("user_id", "tag_value", "n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("s"))).alias("affinity"), F.least(F.lit(0.85), 0.5 + 0.05 * F.col("n")).alias("confidence"))


def texture_affinity(swipes: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    n, likes = F.count("*"), F.count_if(F.col("action") == "right")
    seen = swipes.where(F.col("action").isin("right", "long_press_left")).join(tags.select("recipe_id", "tag_value").distinct(), "recipe_id")
    return seen.groupBy("user_id", "tag_value").agg(n.alias("n"), (likes / n).alias("affinity"), F.least(0.5 + 0.1 * n, F.lit(0.75)).alias("confidence")).where(F.col("n") >= least)


def spice_adjustment(cooks: DataFrame, least: int = 1) -> DataFrame:
    """-1 if most cooks found it too spicy, +1 if most too mild, else 0; per user with at least `least` points."""
    n = F.count("*")
    seen = cooks.where(F.col("spice_feedback").isNotNull()).groupBy("user_id").agg(n.alias("n"), F.count_if(F.col("spice_feedback") == "too_spicy").alias("hot"), F.count_if(F.col("spice_feedback") == "too_mild").alias("mild")).where(F.col("n") >= least)
    return seen.select("user_id", F.when(F.col("hot") * 2 > F.col("n"), -1).when(F.col("mild") * 2 > F.col("n"), 1).otherwise(0).alias("adjustment"))


def _tag_keys(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """(recipe_id, dimension:value), each once, of the recipes of pairs only: tags of others are dropped before rows are grouped."""
    own = tags.join(pairs.select("recipe_id").distinct(), "recipe_id", "left_semi")
    return own.select("recipe_id", F.concat_ws(":", "dimension", "tag_value").alias("tag")).distinct()


def tag_feedback(swipes: DataFrame, cooks: DataFrame, tags: DataFrame) -> DataFrame:
    """Summed signals per user and dimension:value, over the user's largest absolute sum."""
    again = F.when(F.col("would_make_again"), AGAIN).when(~F.col("would_make_again"), NOT_AGAIN).otherwise(0.0)
    seen = swipes.select("user_id", "recipe_id", signal("action").alias("s")).union(cooks.select("user_id", "recipe_id", (SIGNALS["made_it"] + again).alias("s")))
    keys = _tag_keys(tags, seen)
    sums = seen.groupBy("user_id", "recipe_id").agg(F.sum("s").alias("s")).join(keys, "recipe_id").groupBy("user_id", "tag").agg(F.sum("s").alias("s"))
    return normalised(sums, "user_id", "s", "score")


def normalised(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Values over the largest absolute one of their group (0 if that is 0)."""
    most = F.max(F.abs(value)).over(Window.partitionBy(group))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value), most), F.lit(0.0))).drop(value)


def recipe_feedback(scores: DataFrame, tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean score of a recipe's tags that the user has a score for; 0 without any.

    A user's scores are a map and a recipe's tags an array (both are as few as there are kinds of
    tags), so that a pair stays one row.
    """
    told = _tag_keys(tags, pairs).groupBy("recipe_id").agg(F.collect_list("tag").alias("_tags"))
    of_user = scores.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("_scores"))
    known = F.filter(F.transform("_tags", lambda x: F.try_element_at("_scores", x)), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    both = pairs.join(told, "recipe_id", "left").join(of_user, "user_id", "left")
    return both.withColumn("feedback", F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))).drop("_tags", "_scores")


def like_runs(swipes: DataFrame, least: int = 3) -> DataFrame:
    """Maximal runs of "right" by time that another action closes: (user_id, run, swipe_id) of runs of at least `least`."""
    order = Window.partitionBy("user_id").orderBy("swiped_at", "swipe_id")
    s = swipes.withColumn("_break", (F.col("action") != "right").cast("int")).withColumn("run", F.sum("_break").over(order))
    last = F.max("run").over(Window.partitionBy("user_id"))
    likes = s.withColumn("_last", last).where((F.col("_break") == 0) & (F.col("run") < F.col("_last")))
    return likes.withColumn("_n", F.count("*").over(Window.partitionBy("user_id", "run"))).where(F.col("_n") >= least).select("user_id", "run", "swipe_id", "recipe_id")


def common_dimensions(runs: DataFrame, tags: DataFrame, share: float = 0.5) -> DataFrame:
    """Tags of at least `share` of a run's likes."""
    sizes = runs.groupBy("user_id", "run").agg(F.count("*").alias("size"))
    hits = runs.join(tags.select("recipe_id", "dimension", "tag_value").distinct(), "recipe_id").groupBy("user_id", "run", "dimension", "tag_value").agg(F.count("*").alias("n"))
    return hits.join(sizes, ["user_id", "run"]).where(F.col("n") >= share * F.col("size")).select("user_id", "run", "dimension", "tag_value", "n")


def learned_confidence(swipes: DataFrame, cooks: DataFrame) -> DataFrame:
    """(user_id, confidence): 0.85, and up to 0.10 more for swipes (0.001 each) and cooked dishes (0.01 each)."""
    counted = swipes.groupBy("user_id").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("k")).union(cooks.groupBy("user_id").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("k")))
    sums = counted.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return sums.select("user_id", F.least(F.lit(0.95), 0.85 + F.least(F.lit(0.10), 0.001 * F.col("n") + 0.01 * F.col("k"))).alias("confidence"))


#: How much a dimension is liked that a run of likes has in common, and how sure that is.
PATTERN = {"affinity": 0.7, "confidence": 0.6}


def refined_profiles(profiles: DataFrame, swipes: DataFrame, cooks: DataFrame, tags: DataFrame, as_of: Column, days: int = 14, least_cooks: int = 3, known: DataFrame | None = None) -> DataFrame:
    """Profiles (user_id, heat) after what users did in the last days: (user_id, heat, regions, discovered, confidence), a row for each profile.

    heat moves by one where most of least_cooks dishes at least were too spicy or too mild;
    regions maps the regions of two signals at least to affinity and confidence (null without
    any); discovered maps "<dimension>_preference" to affinity and confidence, for dimensions
    of which half the recipes of a closed run of three likes share a value, over those already
    known (user_id, name, affinity, confidence). Confidence counts all time.
    """
    since = as_of - F.make_interval(days=F.lit(days))
    recent, cooked = swipes.where(F.col("swiped_at") >= since), cooks.where(F.col("cooked_at") >= since)
    value = F.struct("affinity", "confidence")
    signals = affinity_by_signals(recent, cooked, tags.where("dimension = 'region'"))
    regions = signals.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("tag_value", value))).alias("regions"))
    found = common_dimensions(like_runs(recent), tags).select("user_id", F.concat("dimension", F.lit("_preference")).alias("name")).distinct()
    found = found.select("user_id", "name", *(F.lit(v).alias(k) for k, v in PATTERN.items()))
    if known is not None:
        found = found.unionByName(known.select(*found.columns).join(found, ["user_id", "name"], "left_anti"))
    discovered = found.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("name", value))).alias("discovered"))
    heat = F.greatest(F.lit(1), F.least(F.lit(5), F.col("heat") + F.coalesce("adjustment", F.lit(0))))
    every = profiles.select("user_id", "heat").join(spice_adjustment(cooked, least_cooks), "user_id", "left")
    for part in (regions, discovered, learned_confidence(swipes, cooks)):
        every = every.join(part, "user_id", "left")
    return every.select("user_id", heat.alias("heat"), "regions", "discovered", F.coalesce("confidence", F.lit(0.85)).alias("confidence"))


#: The parts of a profile that each step of onboarding fills.
STEP_FIELDS = {
    1: [],
    2: ["household"],
    3: ["diet"],
    4: ["regions", "style"],
    5: ["heat", "oil"],
    6: ["gravy", "time"],
    7: [],
    8: ["cook"],
}


def onboarding_sessions(submissions: DataFrame, discovered: DataFrame) -> DataFrame:
    """Submissions (user_id, step from 1 to 8, answer, at, id) as a session of each user: (user_id, answers, current_step, completed, completeness, confidence).

    Of each step the last submission counts, whose answer may be null: the step is submitted, but
    its fields stay empty. current_step follows the step submitted last. Completed sessions, with
    all steps, get their completeness (fields filled, and whether anything is discovered, of ten)
    and confidence (0.95 for explicit answers, 0.6 for the preferences of discovered: user_id, found).
    """
    last = submissions.groupBy("user_id", "step").agg(F.max(F.struct("at", "id", "answer")).alias("x"))
    steps = F.collect_list(F.struct("step", F.col("x.answer").alias("answer")))
    fold = last.groupBy("user_id").agg(F.map_from_entries(steps).alias("answers"), (F.max_by("step", "x") + 1).alias("current_step"), F.count_if(F.col("step").between(1, len(STEP_FIELDS))).alias("n"))
    fold = fold.join(discovered.select("user_id", F.size("found").alias("d")), "user_id", "left").withColumn("d", F.coalesce("d", F.lit(0))).withColumn("completed", F.col("n") == len(STEP_FIELDS))
    filled = sum((F.when(F.try_element_at("answers", F.lit(step)).isNotNull(), len(fields)).otherwise(0) for step, fields in STEP_FIELDS.items() if fields), (F.col("d") > 0).cast("int"))
    complete = F.when(F.col("completed"), filled / (sum(map(len, STEP_FIELDS.values())) + 1))
    sure = F.when(F.col("completed"), (8 * 0.95 + F.col("d") * 0.6) / (8 + F.col("d")))
    return fold.select("user_id", "answers", "current_step", "completed", complete.alias("completeness"), sure.alias("confidence"))


def onboarding_status(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """(user_id, status, percent): of each user; percent of the eight steps while onboarding is in progress."""
    status = F.when(F.col("completed"), "completed").when(F.col("completed").isNotNull(), "in_progress").otherwise("not_started")
    percent = F.when(~F.col("completed"), F.col("current_step") / len(STEP_FIELDS) * 100)
    return users.select("user_id").join(sessions.select("user_id", "current_step", "completed"), "user_id", "left").select("user_id", status.alias("status"), percent.alias("percent"))


def interaction_stats(swipes: DataFrame, cooks: DataFrame) -> DataFrame:
    s = swipes.groupBy("user_id").agg(F.count("*").alias("swipes"), F.count_if(F.col("action") == "right").alias("likes"))
    c = cooks.groupBy("user_id").agg(F.count("*").alias("cooks"))
    both = s.join(c, "user_id", "left").withColumn("cooks", F.coalesce("cooks", F.lit(0)))
    return both.select("user_id", "swipes", "likes", "cooks", F.coalesce(F.try_divide(F.col("likes"), F.col("swipes")), F.lit(0.0)).alias("right_rate"), F.coalesce(F.try_divide(F.col("cooks"), F.col("likes")), F.lit(0.0)).alias("cook_conversion"), (10 - F.col("swipes") % 10).alias("next_refinement_in"))


def refinement_triggers(swipes: DataFrame, every: int = 10) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("swiped_at", "swipe_id"))
    return swipes.withColumn("n", n).where(F.col("n") % every == 0).select("user_id", "swipe_id", "n")


#: What an action on a validation dish says: (test, action) to a preference and its value.
DISCOVERIES = {
    ("perfect_match", "left"): ("perfect_match_rejection", 1.0),
    ("polarizing_ingredient", "long_press_left"): ("polarizing_ingredient_rejected", 1.0),
    ("polarizing_ingredient", "right"): ("polarizing_ingredient_affinity", 0.7),
    ("texture_fermentation", "right"): ("texture_affinity", 0.7),
    ("regional_boundary", "right"): ("regional_openness", 0.7),
    ("wildcard_complexity", "right"): ("experimentation_factor", 0.6),
}


def discovered_preferences(swipes: DataFrame) -> DataFrame:
    """(user_id, found): preferences that swipes (user_id, swiped_at, swipe_id, action, test_type) of validation dishes tell, as a map; the last one of each counts. Users without any are left out."""
    told = F.coalesce(*(F.when((F.col("test_type") == test) & (F.col("action") == action), F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))) for (test, action), (name, value) in DISCOVERIES.items()))
    last = swipes.select("user_id", "swiped_at", "swipe_id", told.alias("p")).where("p IS NOT NULL").groupBy("user_id", "p.name").agg(F.max_by("p.value", F.struct("swiped_at", "swipe_id")).alias("value"))
    return last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("found"))
