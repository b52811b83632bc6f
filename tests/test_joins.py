"""First matches of users against every pair of a user and a recipe."""

import random

from pyspark.sql import functions as F

from ladle import plans
from ladle.operators import joins as J
from ladle.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def test_first_matches_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    users = [(u, rng.choice(["a", "b", None]), rng.choice(["b", "c", None]), rng.choice([True, False, None]), rng.random() < 0.5) for u in range(40)]
    recipes = [(r,) for r in range(60)] + [(3,), (4,)]
    tags = [(rng.randrange(70), *rng.choice([("region", "a"), ("region", "b"), ("region", "c"), ("diet", "veg"), ("diet", "a"), ("texture", "rich"), ("texture", "soft"), ("region", None)])) for _ in range(150)]
    has = {(r, d, v) for r, d, v in tags}
    want = set()
    for u, x, y, veg, rich in users:
        regions = [v for v in (x, y) if v]
        found = [r for r in range(60) if (not regions or any((r, "region", v) in has for v in regions)) and (not veg or (r, "diet", "veg") in has) and (not rich or (r, "texture", "rich") in has)]
        want |= {(u, r) for r in found[:3]}
    got = J.first_matches(spark.createDataFrame(users, "user_id long, x string, y string, veg boolean, rich boolean"), spark.createDataFrame(recipes, "recipe_id long"), spark.createDataFrame(tags, "recipe_id long, dimension string, tag_value string"), "region", ["x", "y"], {"veg": ("diet", ["veg"]), "rich": ("texture", ["rich"])}, 3)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_join_left_or_tags_takes_both_regions(spark):
    t = Tables(spark, SF)
    first = t.tags.where("dimension = 'region'").select("recipe_id", F.col("tag_value").alias("region_1")).join(t.profiles.select("user_id", "region_1"), "region_1")
    got = plans.load().queries()["join_left_or_tags"](spark, SF)
    assert got.join(first, ["user_id", "recipe_id"], "left_anti").count() > 0


def test_diversity_by_brute_force(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(90)] + ["a", "of"]
    rows = [(u, r, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for u in range(6) for r in range(1, 30)]
    sets = {(u, r): {w for w in title.split() if len(w) > 3} for u, r, title in rows}
    want = {(u, r): (1.0, 0.7, 0.4, 0.2)[min(3, sum(len(sets[u, r] & sets[u, q]) >= 2 for q in range(1, r)))] for u, r, _ in rows}
    got = J.diversity(spark.createDataFrame(rows, "user_id long, rank int, title string")).collect()
    assert len(got) == len(want) and {(x["user_id"], x["rank"]): x["diversity"] for x in got} == want
