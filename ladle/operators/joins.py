"""Joins of recipes with ingredients, tags, users and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.sources.scratch import written


def count_missing(ingredients: DataFrame, nutrition: DataFrame) -> DataFrame:
    """Per recipe how many ingredients there are, and how many without nutrition."""
    known = nutrition.select("ingredient_id", F.lit(1).alias("_known"))
    return ingredients.join(known, "ingredient_id", "left").groupBy("recipe_id").agg(F.count("*").alias("n"), F.count_if(F.col("_known").isNull()).alias("missing"))


def all_tags(recipes: DataFrame, tags: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """recipes that have, in every dimension asked for, one of its values (relational division)."""
    hits = None
    for dimension, values in wanted.items():
        test = (F.col("dimension") == dimension) & F.col("tag_value").isin(values)
        hits = test if hits is None else hits | test
    if hits is None:
        return recipes
    full = tags.where(hits).groupBy("recipe_id").agg(F.count_distinct("dimension").alias("n")).where(F.col("n") == len(wanted))
    return recipes.join(full.select("recipe_id"), "recipe_id", "left_semi")


def orphans(vectors: DataFrame, recipes: DataFrame) -> DataFrame:
    """Vectors whose recipe doesn't exist or isn't named; reason tells which."""
    named = vectors.where(F.col("recipe_id").isNotNull()).join(recipes.select("recipe_id"), "recipe_id", "left_anti").withColumn("reason", F.lit("ORPHAN"))
    return named.unionByName(vectors.where(F.col("recipe_id").isNull()).withColumn("reason", F.lit("NO_RECIPE_ID")))


def symmetric_pairs(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair and method, with the score computed last (the higher of equally late ones)."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "method").agg(F.max(F.struct("computed_at", "score")).alias("last")).select("a", "b", "method", "last.score")


def complement(dishes: DataFrame, mapping: dict[str, list[str]], recipes: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    """(dish_id, recipe_id) of the k first recipes of the kinds that go with a dish's kind.

    The k first are found once for each kind of dish, and only then given to the dishes.
    """
    pairs = [(d, r) for d, rs in mapping.items() for r in rs]
    table = dishes.sparkSession.createDataFrame(pairs, f"dish_kind string, `{kind}` string")
    rank = F.row_number().over(Window.partitionBy("dish_kind").orderBy(*order))
    best = recipes.join(table, kind).withColumn("rank", rank).where(F.col("rank") <= k).select("dish_kind", "recipe_id")
    return dishes.join(best, "dish_kind").select("dish_id", "recipe_id")


def pantry_match(ingredients: DataFrame, master: DataFrame, pantry: list[str]) -> DataFrame:
    """Per recipe how many ingredients a pantry word (of over 2 letters) is in a name of, and the score."""
    words = sorted({w.lower() for w in pantry if len(w) > 2})
    named = master.select("ingredient_id", F.array_compact(F.array(F.lower("standard_name"), F.lower("synonym"))).alias("names"))
    hit = F.exists("names", lambda n: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w))) if words else F.lit(False)
    counts = ingredients.join(named.withColumn("hit", hit), "ingredient_id").groupBy("recipe_id").agg(F.count("*").alias("total"), F.count_if("hit").alias("matched"))
    return counts.withColumn("score", F.least(F.col("matched") / F.col("total") + F.least(F.col("matched") / 5, F.lit(0.3)), F.lit(1.0)))


def diversity(candidates: DataFrame, user: str = "user_id", title: str = "title", rank: str = "rank") -> DataFrame:
    """candidates with diversity 1.0, 0.7, 0.4 or 0.2: by how many better-ranked ones of the user share two long words. Ranks must be bounded."""
    words = F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 3))
    # A bit for each word tells most titles apart; where two words of a title have one bit, it can't.
    bits = F.aggregate("_words", F.lit(0).cast("long"), lambda acc, w: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))
    own = candidates.select(user, rank, words.alias("_words")).withColumn("_bits", bits).withColumn("_mixed", F.bit_count("_bits") < F.size("_words"))
    better = own.select(user, F.col(rank).alias("_rank"), F.col("_words").alias("_other"), F.col("_bits").alias("_other_bits"))
    near = F.col("_mixed") | (F.bit_count(F.col("_bits").bitwiseAND(F.col("_other_bits"))) >= 2)
    same = own.join(better, user).where((F.col("_rank") < F.col(rank)) & near & (F.size(F.array_intersect("_words", "_other")) >= 2)).groupBy(user, rank).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return candidates.join(same, [user, rank], "left").withColumn("diversity", F.when(n == 0, 1.0).when(n == 1, 0.7).when(n == 2, 0.4).otherwise(0.2)).drop("_n")


def first_matches(users: DataFrame, recipes: DataFrame, tags: DataFrame, dimension: str, any_of: list[str], needs: dict[str, tuple[str, list[str]]], k: int) -> DataFrame:
    """(user_id, recipe_id): the k smallest recipes of each user that match all that the user states.

    A tag of the dimension must have the value of one of the columns any_of (of a user without
    such values it needn't), and for each of needs (a boolean column of users: dimension, values)
    that holds there must be a tag of one of the values. An outer join with the tags and a
    condition on them leaves the recipes that have such a tag, each once, so what tags say is
    told once a recipe; of recipes with equal values and flags the k smallest serve all users.
    """
    from ladle.operators.ranking import smallest_per

    flags = [F.bool_or((F.col("dimension") == d) & F.col("tag_value").isin(values)).alias(n) for n, (d, values) in needs.items()]
    asked_of = tags.where(F.col("dimension").isin(dimension, *(d for d, _ in needs.values())))
    told = asked_of.groupBy("recipe_id").agg(F.collect_set(F.when(F.col("dimension") == dimension, F.concat(F.lit("="), "tag_value"))).alias("_values"), *flags)
    known = recipes.select("recipe_id").join(told, "recipe_id", "left").select("recipe_id", "_values", *(F.coalesce(n, F.lit(False)).alias(f"_has_{n}") for n in needs))
    every = F.concat(F.array(F.lit("")), F.coalesce("_values", F.array().cast("array<string>")))
    first = smallest_per(written(known.withColumn("_value", F.explode(every)).drop("_values")), ["_value", *(f"_has_{n}" for n in needs)], "recipe_id", k)
    kind = [*any_of, *needs]
    asked = users.select("user_id", *any_of, *(F.coalesce(n, F.lit(False)).alias(n) for n in needs))
    stated = F.array_distinct(F.array_compact(F.array(*(F.concat(F.lit("="), c) for c in any_of))))
    kinds = asked.select(*kind).distinct().withColumn("_value", F.explode(F.when(F.size(stated) > 0, stated).otherwise(F.array(F.lit("")))))
    met = kinds.join(F.broadcast(first), "_value")  # k of each value and flags
    for n in needs:
        met = met.where(~F.col(n) | F.col(f"_has_{n}"))
    best = met.groupBy(*kind).agg(F.slice(F.array_sort(F.collect_set("recipe_id")), 1, k).alias("_ids")).withColumnsRenamed({n: f"_{n}" for n in kind})
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in kind]
    return asked.join(best, same).select("user_id", F.explode("_ids").alias("recipe_id"))


def latest_match(interactions: DataFrame, recommendations: DataFrame, key: list[str]) -> DataFrame:
    """Each interaction with the latest recommendation of its key (null without one)."""
    last = recommendations.groupBy(*key).agg(F.max(F.struct("recommended_at", "rec_id")).alias("_last")).select(*key, "_last.rec_id")
    return interactions.join(last, key, "left")


def nested(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """parents with an array of structs for each kind of child, in the children's given order; without any an empty array."""
    for name, (df, columns) in children.items():
        grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        parents = parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return parents


def array_totals(plans: DataFrame, key: str, ids: str, values: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of values over the ids in an array column; 0 without any."""
    sums = plans.select(key, F.explode(ids).alias("recipe_id")).join(values, "recipe_id").groupBy(key).agg(*(F.sum(c).alias(c) for c in columns))
    return plans.select(key).join(sums, key, "left").na.fill(0, columns)


def scored_pairs(users: DataFrame, recipes: DataFrame, match: Column, score: Column, k: int, least: float, kinds: list[str]) -> DataFrame:
    """The k best recipes of each user whose score is at least `least`; match prunes pairs before they are scored.

    kinds: the columns of users that match and score look at. Users that agree on them share
    one ranking, so the pairs that are scored grow with the kinds, not with the users.
    """
    pairs = users.select(*kinds).distinct().join(recipes, match).withColumn("score", score).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy(*kinds).orderBy(F.desc("score"), "recipe_id"))
    return users.join(pairs.withColumn("rank", rank).where(F.col("rank") <= k), kinds)
