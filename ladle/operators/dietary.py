"""Dietary rules: one pass over a recipe's ingredients for all of them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that help diabetics, hold gluten, or come from animals.
BENEFICIAL = ["fenugreek", "methi", "bitter gourd", "karela", "cinnamon", "dalchini", "bitter melon"]
GLUTEN = ["wheat", "gehun", "atta", "maida", "all-purpose flour", "semolina", "rava", "sooji", "barley", "jau", "rye"]
ROOTS_ALLOWED = ["turmeric", "haldi"]


def _has(words: list[str]) -> Column:
    return F.coalesce(F.lower("standard_name").rlike("|".join(words)), F.lit(False))


def _violations(*cases: tuple[Column, str]) -> Column:
    """Sorted "name (reason)" of all that hold."""
    one = F.array_compact(F.array(*(F.when(test, F.concat("standard_name", F.lit(f" ({why})")) if why else F.col("standard_name")) for test, why in cases)))
    return F.array_sort(F.flatten(F.collect_list(one)))


def dietary_rules(recipes: DataFrame, ingredients: DataFrame, master: DataFrame, gluten: list[str] = GLUTEN, beneficial: list[str] = BENEFICIAL, strict_vegan: bool = False) -> DataFrame:
    """Per recipe the verdict, violations and confidence of each rule.

    A recipe without known ingredients breaks no rule (jain, gluten-free and vegan hold, the
    others don't). "egg" in a name counts, so an eggplant breaks vegan; meat does only with
    strict_vegan. A glycemic index of 0 counts as unknown; the average is taken over ingredient
    rows, so one that a recipe names twice counts twice.
    """
    used = ingredients.join(master, "ingredient_id")
    grain = F.col("category") == "grain"
    kg = F.when(F.col("unit") == "kg", 1000.0).otherwise(1.0)
    root = F.col("is_root_vegetable") & ~F.lower("standard_name").isin(ROOTS_ALLOWED)
    animal = [(F.col("category") == "dairy", "dairy"), (_has(["egg"]), "egg"), (_has(["honey", "shahad"]), "honey")]
    if strict_vegan:
        animal.append((F.col("is_non_veg"), "meat"))
    broken = {
        "jain": [(F.col("is_allium"), "allium"), (root, "root vegetable")],
        "vrat": [(grain & ~F.col("is_vrat_allowed"), "not vrat grain"), (F.col("is_allium"), "allium")],
        "gluten": [(_has(gluten), "")],
        "vegan": animal,
    }
    # Verdicts have flags of their own: where only these are asked for, Spark leaves out the lists.
    flags = [F.bool_or(functools.reduce(lambda x, y: x | y, (F.coalesce(test, F.lit(False)) for test, _ in cases))).alias(f"breaks_{rule}") for rule, cases in broken.items()]
    lists = [_violations(*cases).alias(f"{rule}_violations") for rule, cases in broken.items()]
    found = used.groupBy("recipe_id").agg(
        *flags, *lists,
        F.bool_or(grain & F.col("is_vrat_allowed")).alias("has_vrat_grain"),
        F.avg(F.nullif("glycemic_index", F.lit(0))).alias("average_gi"),
        F.bool_or(_has(beneficial)).alias("has_beneficial"),
        F.sum(F.coalesce(F.col("quantity") * kg / 100 * F.col("protein_per_100g"), F.lit(0.0))).alias("protein"),
    )
    none = F.array().cast("array<string>")
    r = recipes.select("recipe_id", "servings").join(found, "recipe_id", "left")
    r = r.withColumns({f"{rule}_violations": F.coalesce(f"{rule}_violations", none) for rule in broken})
    r = r.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_vrat_grain", "has_beneficial", *(f"breaks_{rule}" for rule in broken))})
    protein = F.coalesce("protein", F.lit(0.0)) / F.coalesce(F.nullif("servings", F.lit(0)), F.lit(1))
    return r.select(
        "recipe_id", (~F.col("breaks_jain")).alias("is_jain"), "jain_violations",
        (~F.col("breaks_vrat") & F.col("has_vrat_grain")).alias("is_vrat"), "vrat_violations", "has_vrat_grain",
        (F.coalesce(F.col("average_gi") < 55, F.lit(False)) | F.col("has_beneficial")).alias("is_diabetic_friendly"), "average_gi", F.when(F.col("average_gi").isNotNull(), 0.8).otherwise(0.6).alias("diabetic_confidence"),
        (protein >= 15).alias("is_high_protein"), protein.alias("protein_per_serving"),
        (~F.col("breaks_gluten")).alias("is_gluten_free"), "gluten_violations", (~F.col("breaks_vegan")).alias("is_vegan"), "vegan_violations",
    )


def dietary_tags(rules: DataFrame, least: float = 0.7) -> DataFrame:
    """(recipe_id, dimension, tag_value, confidence) rows of all rules that are sure enough."""
    rows = [("jain", "is_jain", F.lit(1.0)), ("vrat", "is_vrat", F.lit(0.9)), ("diabetic_friendly", "is_diabetic_friendly", F.col("diabetic_confidence")), ("high_protein", "is_high_protein", F.lit(0.7)), ("gluten_free", "is_gluten_free", F.lit(1.0)), ("vegan", "is_vegan", F.lit(1.0))]
    one = F.array(*(F.struct(F.lit(f"health_{n}").alias("dimension"), F.col(c).cast("string").alias("tag_value"), conf.alias("confidence")) for n, c, conf in rows))
    return rules.select("recipe_id", F.explode(one).alias("t")).select("recipe_id", "t.*").where(F.col("confidence") >= least)
