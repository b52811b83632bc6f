"""Best matches and clusters over members, against brute force over all pairs of members."""

import random

import pytest

from ladle.operators import similarity as M

WEIGHTS = {"title_fuzzy": 0.4, "ingredients": 0.3, "embedding": 0.3}


def frame(spark, rows, schema):
    return spark.createDataFrame(sorted(rows), schema)


def links(rng, classes, n):
    """n random links of different classes with scores."""
    out = {}
    while len(out) < n:
        a, b = sorted(rng.sample(classes, 2))
        out[a, b] = rng.randrange(70, 100) / 100
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_best_matches_of_members(spark, seed):
    rng = random.Random(seed)
    ids = list(range(60))
    # A third of all members share one title, a third one set; some have no title, some no set.
    title = {i: "hot" if rng.random() < 0.3 else f"t{rng.randrange(15)}" for i in ids if rng.random() < 0.9}
    items = {i: "hot" if rng.random() < 0.3 else f"s{rng.randrange(15)}" for i in ids if rng.random() < 0.9}
    class_of = [{i: min(j for j in m if m[j] == v) for i, v in m.items()} for m in (title, items)]
    edges = [links(rng, sorted(set(c.values())), 8) for c in class_of]
    near = links(rng, ids, 40)

    def between(k, i, j):
        x, y = class_of[k].get(i), class_of[k].get(j)
        return 0 if x is None or y is None else 1 if x == y else edges[k].get((min(x, y), max(x, y)), 0)

    want = {}
    for i in ids:
        scores = [(round(0.4 * between(0, i, j) + 0.3 * between(1, i, j) + 0.3 * near.get((min(i, j), max(i, j)), 0), 9), -j) for j in ids if j != i]
        score, other = max(scores)
        if score >= 0.28:
            want[i] = (-other, pytest.approx(score))
    classes = [frame(spark, c.items(), "id long, class_id long") for c in class_of]
    by_class = [frame(spark, [(*k, v) for k, v in e.items()], "a long, b long, score double") for e in edges]
    got = M.best_matches(classes[0], by_class[0], classes[1], by_class[1], frame(spark, [(*k, v) for k, v in near.items()], "a long, b long, score double"), WEIGHTS, 0.28)
    assert {r["id"]: (r["other"], r["score"]) for r in got.collect()} == want
    assert min(v[1].expected for v in want.values()) < 0.5 < max(v[1].expected for v in want.values())


def test_equal_titles_are_linked(spark):
    titles = spark.createDataFrame([(1, "Dal fry"), (2, "dal  FRY!"), (3, "dal fryy"), (4, ""), (5, None)], "recipe_id long, title string")
    assert {tuple(r) for r in M.star(M.title_classes(titles), "recipe_id").collect()} == {(1, 2, 1.0)}
    assert {(r["a"], r["b"]) for r in M.similar_titles(titles).collect()} == {(1, 3)}


def test_labels_in_batches_are_those_of_all(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(1000, 1000)]
    every = frame(spark, pairs, "a long, b long")
    want = {tuple(r) for r in M.components(every).collect()}
    cut = [pairs[:40], pairs[40:41], [], pairs[41:]]
    labels = M.components(frame(spark, cut[0], "a long, b long"))
    for batch in cut[1:]:
        labels = M.merge_components(labels, spark.createDataFrame(batch, "a long, b long"))
    got = [tuple(r) for r in labels.collect()]
    assert set(got) == want and len(got) == len(want)


def test_nearest_in_small_blocks_with_copies(spark):
    """Blocks of any size give what one matrix gives; of equal scores the smallest ids count."""
    import numpy as np

    from ladle.operators import similarity as M

    rng = np.random.default_rng(3)
    base = rng.integers(-1, 2, (60, 4)).astype(float)  # many exact copies
    base[0] = [1, 1, 1, 1]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    unit = base / np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-300)
    cos = np.round(unit @ unit.T, 12)
    want = {(q, i) for q in range(60) for i in [i for i in np.lexsort((np.arange(60), -cos[q])) if i != q and cos[q, i] >= 0.3 - 1e-12][:5]}
    for query_block, block in ((8000, 100_000), (20, 25)):
        hits = M.top_matches(df.withColumnRenamed("id", "query_id"), df, 5, 0.3, query_block=query_block, block=block).collect()
        assert sorted(round(cos[r["query_id"], r["id"]], 9) for r in hits) == sorted(round(cos[q, i], 9) for q, i in want)
    for block in (1000, 17):
        got = M.all_cosines(df, block).collect()
        assert {(r["i"], r["j"]) for r in got} == {(i, j) for i in range(60) for j in range(i + 1, 60)} and len(got) == 60 * 59 // 2
        assert all(abs(r["cos"] - cos[r["i"], r["j"]]) < 1e-9 for r in got)


def test_short_titles_with_a_common_beginning(spark):
    short = M.short_letters(0.85)
    titles = [f"{word} {i}" for word in ("dish", "manual") for i in range(96000, 96300, 2)] + ["manual 9600", "dish 960001", "dish", "a long title of many words 1", "a long title of many words 2", "a long title with many words", "nineteen letters it", "nineteen letters its", "nineteen lettersit"]
    assert 13 <= short <= 19 < max(map(len, titles))
    strings = spark.createDataFrame([(x,) for x in titles], "t string")
    met = M.rest_keys(strings, 0.85, short)
    pairs = met.alias("x").join(met.alias("y"), ["longer", "rest"]).where("x.t < y.t").select("x.t", "y.t").distinct().count()
    assert pairs < len(titles) ** 2 / 2 / 10  # a piece such as "dish " makes nearly half of them meet
    for other in (None, strings.where("t LIKE '%2'")):
        ours = {(r["t"], r["u"]): r["score"] for r in M.similar_strings(strings, 0.85, against=other).collect()}
        some = titles if other is None else [x for x in titles if x.endswith("2")]
        want = spark.createDataFrame(sorted({(min(x, y), max(x, y)) for x in titles for y in some if x != y}), "t string, u string").selectExpr("t", "u", "1 - levenshtein(t, u) / greatest(length(t), length(u)) AS score").where("score >= 0.85 - 1e-12")
        want = {(r["t"], r["u"]): r["score"] for r in want.collect()}
        assert ours.keys() == want.keys() and all(abs(ours[k] - want[k]) < 1e-9 for k in want) and len(want) > 100


@pytest.mark.parametrize("weight, few", [(0.3, True), (0.5, False)])
def test_sets_are_compared_where_they_can_matter(spark, weight, few):
    rng = random.Random(5)
    sets = {i: rng.sample(range(9), rng.randrange(3, 7)) for i in range(120)}
    weights = {"title_fuzzy": 0.4, "ingredients": weight, "embedding": 0.3}
    titles = spark.createDataFrame([(i, i - i % 3) for i in range(0, 24)], "id long, class_id long")
    title_links = spark.createDataFrame([(0, 3, 0.9), (6, 21, 0.86)], "a long, b long, score double")
    near = spark.createDataFrame([(5, 100, 0.7), (101, 102, 0.5)], "a long, b long, score double")
    rows = spark.createDataFrame([(i, x) for i, items in sets.items() for x in items], "id long, item long")
    classes, every = M.set_classes(rows), M.similar_sets(rows)
    some = M.useful_set_links(classes, titles, near, weights, 0.3)
    assert (some.count() < every.count() / 4) == few
    got, want = ({(r["id"], r["other"], round(r["score"], 9)) for r in M.best_matches(titles, title_links, classes.select("id", "class_id"), links, near, weights, 0.3).collect()} for links in (some, every))
    assert got == want and len(got) > 20


def test_groups_around_one_id_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(M, "_spread", None)
    stars = spark.createDataFrame([(10 * i, 10 * i + k) for i in range(5) for k in range(1, 9)], "a long, b long")
    assert {(r["id"], r["component"]) for r in M.components(stars).collect()} == {(10 * i + k, 10 * i) for i in range(5) for k in range(9)}
