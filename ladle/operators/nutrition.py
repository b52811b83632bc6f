"""Nutrition of recipes from their ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grams of one unit; of a cup or millilitre, and of a piece, by a word in the ingredient's name (first match).
UNIT_GRAMS = {"cup": 240, "ml": 1, "liter": 1000, "tablespoon": 15, "tbsp": 15, "teaspoon": 5, "tsp": 5, "gram": 1, "g": 1, "kg": 1000, "kilogram": 1000, "piece": 100, "whole": 150, "medium": 100, "large": 150, "small": 50}
VOLUME_GRAMS = [("rice", 200), ("flour", 200), ("oil", 220), ("ghee", 220), ("sugar", 200), ("dal", 200), ("lentil", 200)]
PIECE_GRAMS = [("onion", 150), ("tomato", 120), ("potato", 150), ("ginger", 30), ("garlic", 5)]
NUTRIENTS = ["calories", "protein_g", "carbs_g", "fat_g", "fiber_g", "sugar_g", "sodium_mg"]


def unit_to_grams(quantity: Column, unit: Column, name: Column, faithful: bool = True) -> Column:
    """Grams of a quantity; an unknown unit counts as grams.

    faithful: a word's weight of a cup is also taken for a millilitre, as in the published rules;
    otherwise only for cups.
    """
    name, plain = F.lower(name), F.trim(F.lower(unit))

    def by_word(table: list[tuple[str, int]]) -> Column:
        return F.coalesce(*(F.when(name.contains(w), F.lit(float(g))) for w, g in table))

    volume = unit.endswith("cup") | ((unit == "ml") if faithful else F.lit(False))
    table = F.create_map(*(x for u, g in UNIT_GRAMS.items() for x in (F.lit(u), F.lit(float(g)))))
    each = F.coalesce(F.when(volume, by_word(VOLUME_GRAMS)), F.when(unit.isin("piece", "whole"), by_word(PIECE_GRAMS)), F.try_element_at(table, plain), F.lit(1.0))
    return quantity * each


def recipe_nutrition(recipes: DataFrame, ingredients: DataFrame, master: DataFrame, nutrition: DataFrame) -> DataFrame:
    """Totals, values per serving, shares of energy, flags and confidence of each recipe with ingredients.

    An ingredient without nutrition counts as missing and adds nothing. Servings that are null
    or 0 count as 1.
    """
    # Foods first: what a unit of each weighs is worked out once a food, and lines are joined once.
    foods = master.select("ingredient_id", "standard_name").join(nutrition.withColumn("_known", F.lit(1)), "ingredient_id", "full")
    units = ["g", "kg", "cup", "tsp", "piece", "ml"]
    name = F.coalesce("standard_name", F.lit(""))
    weights = F.create_map(*(x for u in units for x in (F.lit(u), unit_to_grams(F.lit(1.0), F.lit(u), name))))
    used = ingredients.join(foods.withColumn("_weights", weights), "ingredient_id", "left")
    one = F.coalesce(F.try_element_at("_weights", F.col("unit")), unit_to_grams(F.lit(1.0), F.col("unit"), name))
    sums = used.withColumn("_g", F.col("quantity") * one / 100).groupBy("recipe_id").agg(*(F.sum(F.coalesce(n, F.lit(0.0)) * F.col("_g")).alias(n) for n in NUTRIENTS), F.count("*").alias("total_ingredient_count"), F.count_if(F.col("_known").isNull()).alias("missing_ingredient_count"))
    servings = F.coalesce(F.nullif("servings", F.lit(0)), F.lit(1))
    each = recipes.select("recipe_id", servings.alias("servings")).join(sums, "recipe_id")
    energy = F.col("protein_g") * 4 + F.col("carbs_g") * 4 + F.col("fat_g") * 9

    def share(c: str, factor: int) -> Column:
        return F.when(energy > 0, F.col(c) * factor / energy * 100).otherwise(0.0)

    def per(c: str) -> Column:
        return F.col(c) / F.col("servings")

    return each.select(
        "recipe_id", "servings", *(F.col(n).alias(f"total_{n}") for n in NUTRIENTS), *(per(n).alias(f"serving_{n}") for n in NUTRIENTS),
        share("protein_g", 4).alias("protein_percentage"), share("carbs_g", 4).alias("carbs_percentage"), share("fat_g", 9).alias("fat_percentage"),
        (per("protein_g") >= 15).alias("is_high_protein"), (per("carbs_g") < 20).alias("is_low_carb"), (per("calories") < 300).alias("is_low_calorie"),
        ((per("carbs_g") - per("fiber_g")) * 50 / 100).alias("glycemic_load"),
        (1 - F.col("missing_ingredient_count") / F.col("total_ingredient_count")).alias("confidence"), "missing_ingredient_count", "total_ingredient_count",
    )


def nutrition_label(nutrition: DataFrame) -> DataFrame:
    """A rounded label per recipe; nulls count as 0. (The tiny addend keeps sums that stand on a tie from rounding either way.)"""

    def r(c: str, digits: int = 1) -> Column:
        return F.round(F.coalesce(c, F.lit(0.0)) + 1e-7, digits)

    return nutrition.select("recipe_id", F.struct(r("serving_calories", 0).alias("calories"), r("serving_protein_g").alias("protein"), r("serving_carbs_g").alias("carbs"), r("serving_fat_g").alias("fat")).alias("label"))


def goal_comparison(nutrition: DataFrame, goals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per requested (user_id, recipe_id): shares of the daily targets, and the mean of 1 (met) or 0.5 (not met) over the preferences that are on; 0.5 without any."""
    both = pairs.join(goals, "user_id").join(nutrition, "recipe_id")
    factors = F.array_compact(F.array(*(F.when(F.col(f"prefer_{p}"), F.when(F.col(f"is_{p}"), 1.0).otherwise(0.5)) for p in ("high_protein", "low_carb", "low_calorie"))))
    mean = F.when(F.size(factors) > 0, F.aggregate(factors, F.lit(0.0), lambda a, x: a + x) / F.size(factors)).otherwise(0.5)
    return both.select("user_id", "recipe_id", *(F.round(F.col(f"serving_{n}") / F.col(f"daily_{n}") * 100 + 1e-7, 4).alias(f"pct_{n}") for n in ("calories", "protein_g", "carbs_g", "fat_g")), F.round(mean, 6).alias("alignment"))


def batch_report(requested: DataFrame, nutrition: DataFrame) -> DataFrame:
    return requested.join(nutrition.select("recipe_id", F.lit(True).alias("success")), "recipe_id", "left").withColumn("success", F.coalesce("success", F.lit(False)))
