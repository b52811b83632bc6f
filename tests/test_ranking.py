"""Smallest keys of groups and unions by quota against plain Python and the general forms."""

import random

from pyspark.sql import functions as F

from ladle.operators import ranking as R


def test_smallest_per(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, *range(-50, 50)])) for g in "aabbbbbcx" * 40] + [("y", None), ("z", 3)]
    df = spark.createDataFrame(rows, "g string, k long")
    for k, buckets in ((1, 1), (3, 2), (5, 1024), (200, 8)):
        want = {(g, x) for g in "abcxyz" for x in sorted({v for h, v in rows if h == g and v is not None})[:k]}
        got = [tuple(r) for r in R.smallest_per(df, ["g"], "k", k, buckets).select("g", "k").collect()]
        assert len(got) == len(want) and set(got) == want


def test_quota_lists_as_quota_union(spark):
    rng = random.Random(6)
    rows = [(u, [rng.randrange(9) for _ in range(rng.randrange(5))] or None, [rng.randrange(9) for _ in range(4)]) for u in range(30)]
    df = spark.createDataFrame(rows, "user_id int, a array<int>, b array<int>")
    want = R.quota_union([df.select("user_id", F.explode("a").alias("key")), df.select("user_id", F.explode("b").alias("key"))], ["user_id"], "key", 4)
    got = df.select("user_id", F.inline(R.quota_lists([F.col("a"), F.col("b")], 4)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("user_id", "key", "branch").collect()))
