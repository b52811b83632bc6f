"""Top-k, paging, sampling, unions by quota and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.sources.scratch import written


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (Spark keeps k a partition before it shuffles)."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def smallest_per(df: DataFrame, group: list[str], key: str, k: int, buckets: int = 1024) -> DataFrame:
    """(group, key) of the k smallest keys of each group, each once, with no group sorted whole.

    The k smallest of the minima of hash buckets bound what can be among them (a group that fills
    fewer buckets isn't bound); only keys within the bound are sorted. The bounds of all groups
    are broadcast, so groups must be few.
    """
    pairs = df.select(*group, key).where(F.col(key).isNotNull())
    minima = pairs.groupBy(*group, F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")).agg(F.min(key).alias(key))
    bound = top_per(minima, group, [F.col(key)], k).groupBy(*group).agg(F.when(F.count("*") == k, F.max(key)).alias("_most"))
    return top_per(pairs.join(F.broadcast(bound), group).where(F.col("_most").isNull() | (F.col(key) <= F.col("_most"))).select(*group, key).distinct(), group, [F.col(key)], k)


def page(df: DataFrame, order: list[str], offset: int, limit: int, total: bool = False) -> DataFrame:
    """One page, with the number of all rows if asked for."""
    out = df.orderBy(*order).offset(offset).limit(limit)
    return out.join(F.broadcast(df.agg(F.count("*").alias("total")))) if total else out  # one row


def _seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", key, F.lit(seed)).cast("binary"))


def hash_pick(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in the order of a seeded hash: a random choice that can be repeated."""
    return df.orderBy(_seeded(key, seed), key).limit(k)


def sample_per(df: DataFrame, group: list[str], key: str, seed: int, k: int = 1) -> DataFrame:
    return top_per(df, group, [_seeded(key, seed), F.col(key)], k)


def duplicates_after_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows but the first of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank > 1").drop("_rank")


def latest_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, key, order, 1)


def ordered_list(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """A group's values as an array in the given order."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value")))).alias("_all")).select(group, F.transform("_all", lambda x: x["_value"]).alias(name))


def exclusions(swipes: DataFrame, shown: DataFrame, as_of: Column, days: int, rejected: str = "long_press_left") -> DataFrame:
    """(user_id, recipe_id) rejected ever or shown in the last days."""
    recent = shown.where(F.col("recommended_at") >= as_of - F.make_interval(days=F.lit(days)))
    return swipes.where(F.col("action") == rejected).select("user_id", "recipe_id").union(recent.select("user_id", "recipe_id")).distinct()


def quota_union(branches: list[DataFrame], group: list[str], key: str, limit: int) -> DataFrame:
    """Rows of all branches, each key once by its first branch, limit a group; branch: its number."""
    every = branches[0].withColumn("branch", F.lit(0))
    for i, b in enumerate(branches[1:], 1):
        every = every.unionByName(b.withColumn("branch", F.lit(i)))
    first = every.groupBy(*group, key).agg(F.min("branch").alias("branch"))
    return top_per(first, group, [F.col("branch"), F.col(key)], limit)


def quota_lists(branches: list[Column], limit: int) -> Column:
    """As quota_union, of arrays of keys in a row: an array of (key, branch), each key once by its first branch, limit at most."""
    taken, out = None, []
    for i, keys in enumerate(branches):
        keys = F.array_sort(F.array_distinct(F.coalesce(keys, F.array())))
        out.append(_of_branch(keys if taken is None else F.array_except(keys, taken), i))
        taken = keys if taken is None else F.array_union(taken, keys)
    return F.slice(F.concat(*out), 1, limit)


def _of_branch(keys: Column, i: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(i).alias("branch")))


def card_buckets(buckets: list[tuple[str, DataFrame, list[Column], int]], user: str, cap: int) -> DataFrame:
    """Per user the first rows of each bucket (name, rows, order, quota), bucket after bucket up to cap; a card may stand in two buckets."""
    every = None
    for i, (name, df, order, k) in enumerate(buckets):
        place = F.row_number().over(Window.partitionBy(user).orderBy(*order))
        cards = df.withColumn("_place", place).where(F.col("_place") <= k).withColumns({"card_type": F.lit(name), "_bucket": F.lit(i)})
        every = cards if every is None else every.unionByName(cards)
    return top_per(every, [user], [F.col("_bucket"), F.col("_place")], cap).drop("_bucket", "_place")


def reachable(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of what links (a, b) reach from start (id) in at most depth steps, breadth first."""
    seen = written(start.distinct().withColumn("depth", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        new = front.join(links, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        front = written(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.union(front)
    return seen
