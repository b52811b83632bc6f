"""Validation of recipes and audits of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a title that mark spam.
SPAM = ["click here", "buy now", "limited offer"]


def _issue(test: Column, field: str, severity: str, message: str) -> Column:
    return F.when(test, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def _numbered(test: Column, field: Column, message: str) -> Column:
    return F.when(test, F.struct(field.alias("field"), F.lit("WARNING").alias("severity"), F.lit(message).alias("message")))


def validation_issues(recipes: DataFrame, spam: list[str] = SPAM) -> DataFrame:
    """(recipe_id, field, severity, message) of recipes.

    recipes: title, source_url, creator, description, ingredients (array of name, quantity),
    steps (array of texts), prep, cook and total (minutes). Null arrays count as empty.
    """
    title, url = F.coalesce("title", F.lit("")), F.coalesce("source_url", F.lit(""))
    items, steps = F.coalesce(F.size("ingredients"), F.lit(0)), F.coalesce(F.size("steps"), F.lit(0))
    checks = [
        *(_issue(F.coalesce(c, F.lit("")) == "", c, "ERROR", "missing") for c in ("title", "source_url", "creator")),
        _issue((title != "") & (F.length(title) < 3), "title", "ERROR", "too short"),
        _issue(F.length(title) > 200, "title", "WARNING", "too long"),
        _issue(F.lower(title).rlike("|".join(spam)), "title", "ERROR", "spam"),
        _issue(F.length(F.coalesce("description", F.lit(""))) < 20, "description", "WARNING", "missing or too short"),
        _issue(items <= 0, "ingredients", "ERROR", "none"),
        _issue(items == 1, "ingredients", "WARNING", "very few"),
        _issue(steps <= 0, "instructions", "ERROR", "none"),
        _issue(steps == 1, "instructions", "WARNING", "very few"),
        *(_issue(~F.col(c).between(0, 1440), c, "WARNING", "out of range") for c in ("prep", "cook", "total")),
        _issue((F.col("prep") > 0) & (F.col("cook") > 0) & (F.col("total") > 0) & (F.col("total") < F.col("prep") + F.col("cook")), "total", "WARNING", "less than prep and cook"),
        _issue((url != "") & ~url.rlike("^https?://"), "source_url", "ERROR", "scheme"),
        _issue(F.length(url) > 2048, "source_url", "WARNING", "too long"),
    ]

    def of_item(x: Column, i: Column) -> Column:
        name, quantity = F.format_string("ingredients[%d]", i), F.format_string("ingredients[%d].quantity", i)
        return F.array(_numbered(F.coalesce(F.trim(x["name"]), F.lit("")) == "", name, "missing name"), _numbered(x["quantity"] < 0, quantity, "must be positive"), _numbered(x["quantity"] > 10000, quantity, "unreasonably large"))

    def of_step(x: Column, i: Column) -> Column:
        return F.array(_numbered(F.length(F.trim(F.coalesce(x, F.lit("")))) < 10, F.format_string("instructions[%d]", i), "too short or empty"))

    none = F.array().cast("array<struct<field:string,severity:string,message:string>>")
    each = [F.coalesce(F.flatten(F.transform(c, f)), none) for c, f in (("ingredients", of_item), ("steps", of_step))]
    found = F.array_compact(F.concat(F.array(*checks), *each))
    return recipes.select("recipe_id", F.explode(found).alias("i")).select("recipe_id", "i.*")


def validation_summary(recipes: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("recipe_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    both = recipes.select("recipe_id").join(counts, "recipe_id", "left").na.fill(0, ["errors", "warnings"])
    return both.withColumn("is_valid", F.col("errors") == 0)


def embedding_audit(vectors: DataFrame, recipes: DataFrame) -> DataFrame:
    """One row: valid, orphaned, missing and surplus vectors. vectors: point_id, recipe_id."""
    known = recipes.select("recipe_id", F.lit(True).alias("known"))
    per = vectors.groupBy("recipe_id").agg(F.count("*").alias("n")).join(known, "recipe_id", "full")
    has = F.coalesce("n", F.lit(0))
    return per.agg(F.sum(F.when(F.col("known"), has).otherwise(0)).alias("valid"), F.sum(F.when(F.col("known").isNull(), has).otherwise(0)).alias("orphaned"), F.count_if(F.col("known") & (has == 0)).alias("missing"), F.sum(F.greatest(has - 1, F.lit(0))).alias("surplus"))


def tag_report(tags: DataFrame, dimensions: DataFrame, least: float) -> DataFrame:
    """Per recipe: tags in all, kept ones (allowed values, confidence of least or more), filtered ones, and whether no required dimension lacks a kept tag."""
    from ladle.operators.filters import allowed_tags

    kept = allowed_tags(tags.withColumn("values", F.array("tag_value")), dimensions).where(F.col("confidence") >= least)
    required = kept.join(dimensions.where("is_required").select("dimension", F.lit(True).alias("required")), "dimension", "left")
    good = required.groupBy("recipe_id").agg(F.count("*").alias("kept"), F.count_distinct(F.when(F.col("required"), F.col("dimension"))).alias("have"))
    needed = dimensions.where("is_required").count()
    every = tags.groupBy("recipe_id").agg(F.count("*").alias("total")).join(good, "recipe_id", "left").na.fill(0, ["kept", "have"])
    return every.select("recipe_id", "total", "kept", (F.col("total") - F.col("kept")).alias("filtered"), (F.col("have") == needed).alias("is_valid"))


#: How sure a proposed tag of a dimension is.
PROPOSED = {"diet": 0.90, "region": 0.85, "allium": 0.95, "meal": 0.80}


def proposed_tags(proposals: DataFrame, recipes: DataFrame) -> DataFrame:
    """Tag rows out of one struct a recipe (recipe_id and a column for each dimension, scalars or arrays); unknown recipes and dimensions go."""
    kinds = {f.name: f.dataType.typeName() for f in proposals.schema}
    rows = [F.struct(F.lit(d).alias("dimension"), (F.col(d) if kinds[d] == "array" else F.array(F.col(d).cast("string"))).alias("values"), F.lit(v).alias("confidence")) for d, v in PROPOSED.items() if d in kinds]
    known = proposals.join(recipes.select("recipe_id"), "recipe_id", "left_semi")
    return known.select("recipe_id", F.explode(F.array(*rows)).alias("p")).select("recipe_id", "p.dimension", F.explode("p.values").alias("tag_value"), "p.confidence").where("tag_value IS NOT NULL")
