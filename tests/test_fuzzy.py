"""Most alike names through letters in common, against every item with every name."""

import random

import pytest

from ladle.operators import similarity as M


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0


def words(rng, number, letters="abcdefghijklmnopqrstuvwxyzäé "):
    """Strings of many lengths, a third of them made from others by some edits."""
    out = ["".join(rng.choices(letters, k=rng.randrange(1, 24))) for _ in range(number)]
    for i in range(0, number, 3):
        s = list(rng.choice(out))
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice([*letters, "", "zz"])
        out[i] = "".join(s)
    return out


@pytest.mark.parametrize("least", [40, 70, 100])
def test_most_alike_by_brute_force(spark, least):
    rng = random.Random(least)
    every = words(rng, 240) + ["a", "aa", "aaaaaaaaaaaa", "aaaaaaaaaaab", "", "😀😀x", "😀x"]
    items = sorted(set(every[::2])) + [None]
    names = [(s, i) for i, s in enumerate(every[1::2] + every[:40])] + [(None, 9999), ("", 9998)]
    want = {}
    for item in items:
        if item:
            score, i = max((ratio(item, n), -i) for n, i in names if n is not None)
            if score >= least:
                want[item] = (-i, score)
    left, right = spark.createDataFrame([(s,) for s in items], "item_l string"), spark.createDataFrame(names, "name_l string, name_id long")
    got = {r["item_l"]: (r["name_id"], r["score"]) for r in M.most_alike(left, right, least).collect()}
    assert want and got == want
    assert M.most_alike(left, right.where("false"), least).count() == M.most_alike(left.where("false"), right, least).count() == 0


def test_candidates_are_few(spark):
    """Of all pairs, those that are alike are among the candidates, and most of the others are not."""
    rng = random.Random(5)
    items, names = sorted(set(words(rng, 400)) - {""}), sorted(set(words(rng, 400)) - {""})
    left, right = spark.createDataFrame([(s,) for s in items], "s string"), spark.createDataFrame([(s,) for s in names], "u string")
    near = {(r["s"], r["u"]) for r in M.alike_candidates(left, right, 70).collect()}
    assert {(a, b) for a in items for b in names if ratio(a, b) >= 70} <= near
    assert 20 * len(near) < len(items) * len(names)
    with pytest.raises(ValueError):
        M.alike_candidates(left, right, 0)
