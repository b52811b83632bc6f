"""Literals, and plans that must not hold what they shouldn't."""

import pytest
from pyspark.sql import functions as F

from ladle.functions import text as T
from ladle.operators import joins as J
from ladle.operators import similarity as M
from ladle.sources import tables as S

LINES = [
    ("140 Grams Whole Urad Dal", 140.0, "grams", "Whole Urad Dal"), ("2 cups water", 2.0, "cups", "Water"), ("1 tablespoon oil", 1.0, "tablespoon", "Oil"),
    ("Salt to taste", None, None, "Salt To Taste"), ("½ teaspoon turmeric powder", 0.5, "teaspoon", "Turmeric Powder"), ("200 grams paneer, cubed", 200.0, "grams", "Paneer"),
    ("2-3 green chilies, chopped", None, None, "Green Chilies"), ("1½ cups flour", 0.5, "cups", "Flour"), ("1.5 cups rice", 1.0, "cups", "Rice"), ("1/2 cup milk", None, "cup", "Milk"),
]


def test_ingredient_lines(spark):
    df = spark.createDataFrame([(x[0],) for x in LINES], "s string").select("s", T.parse_ingredient(F.col("s")).alias("p")).select("s", "p.*")
    assert {r["s"]: (r["quantity"], r["unit"], r["item"]) for r in df.collect()} == {x[0]: x[1:] for x in LINES}
    right = spark.createDataFrame([("1½ cups flour",), ("1.5 cups rice",), ("1/2 cup milk",)], "s string").select(T.parse_ingredient(F.col("s"), "correct")["quantity"].alias("q"))
    assert [r["q"] for r in right.collect()] == [1.5, 1.5, 0.5]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fuzz_ratio(spark):
    words = ["aloo gobi masala", "aloo gobhi masala", "", "dal", "ladle"]
    pairs = [(a, b) for a in words for b in words]
    got = [r["r"] for r in spark.createDataFrame(pairs, "a string, b string").select(T.fuzz_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0 for a, b in pairs]


def test_similar_titles_by_fuzz_ratio(spark):
    titles = ["red widget", "red widgets", "red gadget", "blue bolt", "bleu bolt", "hot gear", "hot  Gear!"]
    df = spark.createDataFrame(list(enumerate(titles)), "recipe_id long, title string")
    got = {(r["a"], r["b"]) for r in M.similar_titles(df, 0.85, "indel").collect()}
    plain = ["red widget", "red widgets", "red gadget", "blue bolt", "bleu bolt", "hot gear"]
    assert {r["recipe_id"]: r["class_id"] for r in M.title_classes(df).collect()} == {i: min(i, 5) for i in range(7)}
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if round(200 * lcs(plain[i], plain[j]) / (len(plain[i]) + len(plain[j]))) >= 85}
    assert got == want


def test_no_product_in_similarity_plans(spark):
    df = spark.createDataFrame([(i, f"title {i}") for i in range(20)], "recipe_id long, title string")
    assert "CartesianProduct" not in M.similar_titles(df)._jdf.queryExecution().toString()


@pytest.mark.parametrize("html, source", [('<meta property="og:image" content="/a.jpg">', "og_image"), ('<img src="/logo.png"><img src="b.jpg">', "first_image"), ("<p>", None)])
def test_main_image(spark, html, source):
    from ladle.operators.extract import main_image

    row = spark.range(1).select(main_image(F.lit(html), F.lit(None).cast("string"), F.lit("https://x.org/r/1")).alias("i")).first()["i"]
    assert (row and row["source"]) == source


def test_jsonld_forms(spark):
    from ladle.operators.extract import instructions, jsonld_recipe

    recipe = '{"@type":"Recipe","name":"Dal","recipeInstructions":[{"@type":"HowToSection","itemListElement":[{"text":"a"},{"text":"b"}]},{"@type":"HowToStep","text":"c"}]}'
    for body in (recipe, f"[{recipe}]", f'{{"@graph":[{{"@type":"Page"}},{recipe}]}}'):
        html = f'<script type="application/ld+json">{body}</script>'
        row = spark.range(1).select(jsonld_recipe(F.lit(html)).alias("r")).select(F.get_json_object("r", "$.name").alias("n"), instructions(F.col("r")).alias("s")).first()
        assert (row["n"], row["s"]) == ("Dal", ["a", "b", "c"])


def test_sitemap_and_url_list(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.org/1 </loc></url><url><loc>https://a.org/2</loc></url></urlset>")
    assert {r["loc"] for r in S.read_sitemap(spark, str(tmp_path / "s.xml")).collect()} == {"https://a.org/1", "https://a.org/2"}
    (tmp_path / "u.txt").write_text("a\n\n  b \n")
    assert {r["url"] for r in S.read_url_list(spark, str(tmp_path / "u.txt")).collect()} == {"a", "b"}


def test_all_tags_without_filter(spark):
    recipes = spark.createDataFrame([(1,), (2,)], "recipe_id long")
    tags = spark.createDataFrame([(1, "spice", "hot")], "recipe_id long, dimension string, tag_value string")
    assert J.all_tags(recipes, tags, {}).count() == 2
    assert [r[0] for r in J.all_tags(recipes, tags, {"spice": ["hot"]}).collect()] == [1]


def test_whole_days_count_parts_of_seconds(spark):
    from pyspark.sql import functions as F

    from ladle.functions import text as T

    rows = [("2024-01-30 00:00:00.000001", 0), ("2024-01-30 00:00:00", 1), ("2024-01-29 23:59:59.999999", 1), ("2024-01-31 00:00:00.5", -1), ("2024-02-01 00:00:00", -1)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string").select(T.whole_days(F.col("s").cast("timestamp_ntz"), F.lit("2024-01-31").cast("timestamp_ntz")).alias("d"))
    assert [r["d"] for r in df.collect()] == [d for _, d in rows]


def test_parsed_lines_as_parsed_one_by_one(spark, monkeypatch):
    """Each text is parsed once, however many lines have it; lines without text stay."""
    from pyspark.sql import functions as F

    from ladle.functions import text as T
    from ladle.sources import scratch

    sizes, keep = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df: sizes.append(keep(df)) or sizes[-1])
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["2 cups rice, cooked", "1 kg salt", "2 cups rice, cooked", None, ""] * 3)], "line int, text string")
    want = df.select("line", T.parse_ingredient(F.col("text")).alias("p")).select("line", "p.*")
    got = T.parsed_lines(df, "text")
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert sizes[0].count() == 4
