"""Predicates and projections over recipes, pages, tags and profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a title that break a diet.
MEAT = ["chicken", "mutton", "lamb", "fish", "prawn", "shrimp", "egg", "meat", "beef", "pork", "keema", "gosht"]
ALLIUM = ["onion", "garlic", "pyaz", "lehsun", "lasun"]
DAIRY = ["paneer", "cheese", "milk", "cream", "butter", "ghee", "curd", "yogurt", "dahi", "malai", "makhani"]
#: Blocks of Devanagari, Kannada, Tamil, Telugu and Malayalam.
NON_LATIN = "[\\u0900-\\u097F\\u0C80-\\u0CFF\\u0B80-\\u0BFF\\u0C00-\\u0C7F\\u0D00-\\u0D7F]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_range(c: str | Column, least=None, most=None, null_passes: bool = False) -> Column:
    """least <= c <= most, either bound may be absent; null fails unless null_passes."""
    c = _col(c)
    test = F.lit(True)
    for bound, holds in ((least, c >= F.lit(least)), (most, c <= F.lit(most))):
        if bound is not None:
            test = test & holds
    return F.coalesce(test, F.lit(null_passes))


def keyword(words: str, *columns: str) -> Column:
    """Whether any column contains the words, in any case (% and _ keep their meaning)."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
    return test


def any_keyword(c: str | Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(_col(c)).rlike("|".join(re.escape(w.lower()) for w in words)), F.lit(False))


def with_tag(recipes: DataFrame, tags: DataFrame, dimension: str, values: list[str]) -> DataFrame:
    """recipes that have one of the values in a dimension; all of them if no value is asked for."""
    if not values:
        return recipes
    return recipes.join(tags.where((F.col("dimension") == dimension) & F.col("tag_value").isin(values)).select("recipe_id"), "recipe_id", "left_semi")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def json_has(c: str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(c)), path, "string").isNotNull()


def json_all_missing(c: str, paths: list[str]) -> Column:
    """Whether none of the paths holds a non-empty text."""
    return F.coalesce(*(F.nullif(F.get_json_object(c, p), F.lit("")) for p in paths)).isNull()


def extraction_class(name: Column, ingredients: Column, scraped: Column) -> Column:
    return F.when(name & ingredients, "complete_schema").when(name, "incomplete_schema").when(scraped, "recipe_scrapers").otherwise("manual")


def url_matches(c: str, include: list[str], exclude: list[str]) -> Column:
    """Any of include and none of exclude, as substrings in any case."""
    test = any_keyword(c, include) if include else F.lit(True)
    return test & ~any_keyword(c, exclude) if exclude else test


def page_kind(c: str, category: list[str], recipe: list[str]) -> Column:
    return F.when(any_keyword(c, category), "category").when(any_keyword(c, recipe), "recipe").otherwise("other")


def first_match(c: str, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first rule whose substring the column contains."""
    return F.coalesce(*(F.when(F.col(c).contains(s), v) for s, v in rules), F.lit(otherwise))


def html_issue(html: str, has_metadata: Column) -> Column:
    return F.when(F.substring(html, 1, 20).rlike("JFIF|PNG|GIF|JPEG"), "binary_image").when(~has_metadata, "no_metadata").otherwise("ok")


def non_latin(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(NON_LATIN), F.lit(False))


def title_flags(recipes: DataFrame, meat: list[str] = MEAT, allium: list[str] = ALLIUM, dairy: list[str] = DAIRY) -> DataFrame:
    """recipes with what their titles break: computed once a recipe, not once a pair."""
    return recipes.withColumns({"foreign": non_latin("title"), "has_meat": any_keyword("title", meat), "has_allium": any_keyword("title", allium), "has_dairy": any_keyword("title", dairy)})


def passing_pairs(pairs: DataFrame, profiles: DataFrame, flagged: DataFrame) -> DataFrame:
    """The pairs (user_id, recipe_id) that no hard constraint rejects, with the columns of profiles and title_flags."""
    veg, no_allium = F.col("diet").isin("pure_veg", "vegetarian"), F.col("allium_status") != "both"
    breaks = F.col("foreign") | (veg & F.col("has_meat")) | (no_allium & F.col("has_allium")) | (F.col("is_dairy_free") & F.col("has_dairy"))
    prohibited = F.exists("prohibitions", lambda p: F.contains(F.lower("title"), F.lower(p)))
    return pairs.join(profiles, "user_id").join(flagged, "recipe_id").where(~(breaks | prohibited))


def first_reason(**reasons: Column) -> Column:
    """The name of the first condition that holds; null if none does."""
    return F.coalesce(*(F.when(test, name) for name, test in reasons.items()))


def retryable(raw: DataFrame, processed: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    return raw.where(~blank("html") & (F.col("attempts") < attempts) & ~F.col("failed")).join(processed, key, "left_anti")


def allowed_tags(tags: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Tags of known dimensions whose values are all allowed (a dimension without a list allows any). tags: values array."""
    joined = tags.join(dimensions.select("dimension", "allowed_values"), "dimension")
    return joined.where(F.col("allowed_values").isNull() | (F.size(F.array_except("values", "allowed_values")) == 0)).drop("allowed_values")


def missing_dimensions(recipes: DataFrame, tags: DataFrame, required: DataFrame) -> DataFrame:
    """(recipe_id, dimension) of required dimensions that a recipe has no tag of."""
    have = tags.groupBy("recipe_id").agg(F.collect_set("dimension").alias("have"))  # at most as many as dimensions
    every = required.agg(F.collect_set("dimension").alias("every"))
    both = recipes.join(have, "recipe_id", "left").join(every)
    return both.select("recipe_id", F.explode(F.array_except("every", F.coalesce("have", F.array().cast("array<string>")))).alias("dimension"))


def flag_names(**flags: Column) -> Column:
    return F.array_compact(F.array(*(F.when(test, name) for name, test in flags.items())))


def adjusted_heat(heat: str, multigenerational: Column) -> Column:
    return F.when(multigenerational & (F.col(heat) > 2), F.col(heat) - 1).otherwise(F.col(heat))


def mapped_values(values: Column, mapping: dict[str, list[str]], default: list[str]) -> Column:
    """Sorted distinct values that a list maps to; default for an unmapped one."""
    table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: F.coalesce(table[v], F.array(*map(F.lit, default)))))))


def with_fallback(df: DataFrame, source: list[str], hit: Column) -> DataFrame:
    """Rows that hit; of a source without any hit all rows."""
    return df.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy(*source))).where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def register_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with is_new: whether known lacks the URL."""
    return found.join(known.withColumn("_known", F.lit(True)), "url", "left").select(*found.columns, F.col("_known").isNull().alias("is_new"))
