"""Refined profiles, onboarding sessions and books of recipes on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from ladle.operators import extract as X
from ladle.operators import learning as L

NOW = datetime.datetime(2024, 1, 31)


def day(n, minute=0):
    return NOW - datetime.timedelta(days=n) + datetime.timedelta(minutes=minute)


def test_refined_profiles(spark):
    profiles = spark.createDataFrame([(1, 5), (2, 1), (3, 3), (4, 2)], "user_id long, heat int")
    # User 1 likes three of a kind and then none; user 2 did the same a month ago; user 3's run of likes is still open.
    acts = ["right", "right", "right", "view"]
    rows = [(u, 10 * u + i, i, day(ago, i), a) for u, ago in ((1, 3), (2, 30)) for i, a in enumerate(acts)] + [(3, 30 + i, i, day(1, i), "right") for i in range(3)]
    swipes = spark.createDataFrame(rows, "user_id long, swipe_id long, recipe_id long, swiped_at timestamp_ntz, action string")
    cooks = spark.createDataFrame([(1, 9, day(2), True, "too_mild"), (1, 9, day(2), None, "too_mild"), (1, 9, day(2), None, "too_mild"), (2, 9, day(30), None, "too_spicy")], "user_id long, recipe_id long, cooked_at timestamp_ntz, would_make_again boolean, spice_feedback string")
    tags = spark.createDataFrame([(0, "region", "north"), (1, "region", "north"), (2, "region", "south"), (0, "texture", "dry"), (1, "texture", "wet"), (2, "texture", "soft"), (3, "region", "west")], "recipe_id long, dimension string, tag_value string")
    known = spark.createDataFrame([(1, "region_preference", 0.2, 0.2), (4, "spice_preference", 0.9, 0.9)], "user_id long, name string, affinity double, confidence double")
    got = {r["user_id"]: r for r in L.refined_profiles(profiles, swipes, cooks, tags, F.lit(NOW).cast("timestamp_ntz"), known=known).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[u]["heat"] for u in (1, 2, 3, 4)] == [5, 1, 3, 2]
    assert got[1]["regions"]["north"]["affinity"] == pytest.approx(0.9) and list(got[1]["regions"]) == ["north"]
    assert got[2]["regions"] is None and got[4]["regions"] is None
    assert {k: v["affinity"] for k, v in got[1]["discovered"].items()} == {"region_preference": 0.7}
    assert got[2]["discovered"] is None and got[3]["discovered"] is None
    assert {k: v["confidence"] for k, v in got[4]["discovered"].items()} == {"spice_preference": 0.9}
    assert [got[u]["confidence"] for u in (1, 2, 3, 4)] == pytest.approx([0.85 + 0.034, 0.85 + 0.014, 0.853, 0.85])
    none = L.refined_profiles(profiles, swipes.where("false"), cooks.where("false"), tags.where("false"), F.lit(NOW).cast("timestamp_ntz"))
    assert {(r["heat"], r["regions"], r["discovered"], r["confidence"]) for r in none.collect()} == {(h, None, None, 0.85) for h in (1, 2, 3, 5)}


def test_onboarding_sessions(spark):
    rows = [(1, s, f"answer {s}", day(5, s), s) for s in range(1, 9)] + [(1, 4, None, day(4), 20), (1, 2, "old", day(9), 21)] + [(2, 3, "veg", day(3), 30), (2, 2, "two", day(2), 31)]
    submitted = spark.createDataFrame(rows, "user_id long, step int, answer string, at timestamp_ntz, id long")
    found = spark.createDataFrame([(1, {"texture_affinity": 0.7})], "user_id long, found map<string,double>")
    sessions = L.onboarding_sessions(submitted, found)
    got = {r["user_id"]: r for r in sessions.collect()}
    assert got[1]["completed"] and got[1]["answers"][2] == "answer 2" and got[1]["answers"][4] is None
    assert got[1]["current_step"] == 5  # step 4 was submitted again, last of all
    assert got[1]["completeness"] == pytest.approx(0.8) and got[1]["confidence"] == pytest.approx((8 * 0.95 + 0.6) / 9)
    assert (got[2]["completed"], got[2]["current_step"], got[2]["completeness"], got[2]["confidence"]) == (False, 3, None, None)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    assert {tuple(r) for r in L.onboarding_status(users, sessions).collect()} == {(1, "completed", None), (2, "in_progress", 37.5), (3, "not_started", None)}


def test_books(spark):
    books = spark.createDataFrame([("a", "one\ntwo\nthree"), ("b", None), ("c", "")], "file string, text string")
    assert {tuple(r) for r in X.book_chunks(books, 8).collect()} == {("a", 0, "one\ntwo"), ("a", 1, "three"), ("c", 0, "")}
    answers = [("a", '```json\n[{"title": "Dal"}, {"title": "Dal"}, {"name": "x"}]\n```'), ("a", '[{"title": "Rice"}]'), ("b", "sorry, nothing"), ("b", '[{"title": "Dal"}]'), ("c", None)]
    existing = spark.createDataFrame([("pdf://a#Rice",), ("pdf://a#Rice",)], "url string")
    found = X.book_recipes(spark.createDataFrame(answers, "file string, answer string"), existing)
    assert {tuple(r) for r in found.collect()} == {("a", "pdf://a#Dal", "Dal", True, 2), ("a", "pdf://a#untitled", "untitled", True, 1), ("a", "pdf://a#Rice", "Rice", False, 1), ("b", "pdf://b#Dal", "Dal", True, 1)}
    assert {tuple(r) for r in X.book_report(found).collect()} == {("a", 4, 2, 2), ("b", 1, 1, 0)}


def test_pantry_and_seasonal_cards(spark):
    from ladle.operators import recommend as C

    cards = spark.createDataFrame([(1, 10, ["Dal", "rice"]), (1, 11, ["okra"]), (1, 12, []), (2, 10, ["dal", "rice"]), (3, 11, ["okra"])], "user_id long, recipe_id long, names array<string>")
    pantry = spark.createDataFrame([(1, "DAL"), (1, "dal"), (2, None)], "user_id long, item string")
    assert {(r["user_id"], r["recipe_id"], r["share"]) for r in C.pantry_cards(cards, pantry).collect()} == {(1, 10, 0.5), (1, 11, 0.0), (1, 12, 0.0)}
    recipes = spark.createDataFrame([(10, day(365)), (11, day(200)), (12, None)], "recipe_id long, processed_at timestamp_ntz")
    found = C.seasonal_cards(cards, pantry, recipes, F.lit(NOW).cast("timestamp_ntz"))
    assert {(r["user_id"], r["recipe_id"]) for r in found.collect()} == {(2, 10)}
