"""Similar titles, ingredient sets and vectors; clusters; vector search."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions import text as T
from ladle.sources.scratch import discard, written


def title_classes(titles: DataFrame) -> DataFrame:
    """(recipe_id, class_id, t): recipes (recipe_id, title) with the smallest id of those whose normalised title is equal; empty titles are left out."""
    own = titles.select("recipe_id", T.normalize_title(F.col("title")).alias("t")).where("t <> ''")
    return own.join(own.groupBy("t").agg(F.min("recipe_id").alias("class_id")), "t").select("recipe_id", "class_id", "t")


def similar_titles(titles: DataFrame, least: float = 0.85, measure: str = "levenshtein", new: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of classes of titles that are that alike; a < b are the class ids of title_classes.

    Recipes of equal titles form a class, and only classes are paired, so that a group of many
    equal titles gives one row for each of its links. new (recipe_id of titles): only their
    titles are held against all.
    """
    classes = title_classes(titles)
    groups = classes.select("class_id", "t").distinct()
    asked = groups if new is None else classes.join(new.select("recipe_id"), "recipe_id", "left_semi").select("t").distinct()
    close = similar_strings(asked.select("t"), least, measure, groups.select("t"))
    both = close.join(groups.withColumnRenamed("class_id", "x"), "t").join(groups.select(F.col("class_id").alias("y"), F.col("t").alias("u")), "u")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def similar_strings(strings: DataFrame, least: float, measure: str = "levenshtein", against: DataFrame | None = None) -> DataFrame:
    """(t, u, score), t < u, of distinct strings that are that alike: of strings (t) with those of against (t; strings themselves if not given).

    Strings that are short share what is left of them without some letters (`rest_keys`).
    Longer ones share one of their pieces: a string is cut into as many pieces as the edits
    allowed plus one, of which one at least must stand in the other near its place.
    """
    other = strings if against is None else against.select("t")
    short = short_letters(least, measure)
    pieces = cut_pieces(longish(strings, least, short), least, measure)
    grams = substrings(longish(other, least, short).select(F.col("t").alias("u"), F.length("t").alias("m")), pieces.select("size").distinct())
    found = score_strings(pieces, grams, least, measure, short=short)
    if not short:
        return found
    return found.union(score_rests(rest_keys(strings, least, short), rest_keys(other, least, short), least))


#: Keys that a short string may have for each length of a longer one.
REST_KEYS = 256


def _edits(n: int, least: float) -> int:
    """Edits allowed between two strings of which the longer one has n letters."""
    return math.floor((1 - least) * n + 1e-6)


def short_letters(least: float, measure: str = "levenshtein") -> int:
    """Letters up to which strings meet through rest_keys, as long as these are few."""
    n = 0
    while measure == "levenshtein" and _edits(n + 1, least) <= n and math.comb(n + 1, _edits(n + 1, least)) <= REST_KEYS and n < 100:
        n += 1
    return n


def longish(strings: DataFrame, least: float, short: int) -> DataFrame:
    """Strings (t) that may be similar to one of more than `short` letters."""
    return strings.where(F.length("t") >= math.ceil(least * (short + 1) - 1e-6)) if short else strings


def rest_keys(strings: DataFrame, least: float, short: int) -> DataFrame:
    """(t, longer, rest, whole): what is left of each string t of at most `short` letters without some of its letters, for each length (longer) of the longer string of a pair; whole: t has that length.

    Two strings within k edits, of which the longer one has n letters, have n - k letters in common in
    order. So the longer one without any k letters and the other one without as many as leave
    n - k have a rest in common, and few others have it: a word that most strings begin with
    makes none of them meet.
    """
    plan = [(n, m, _edits(m, least) - (m - n)) for m in range(1, short + 1) for n in range(m - _edits(m, least), m + 1) if n]
    rests = [F.array("t")]
    for _ in range(max((drop for *_, drop in plan), default=0)):
        rests.append(F.array_distinct(F.flatten(F.transform(rests[-1], lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))))
    of = F.lit(None).cast("array<string>")
    for drop, rest in enumerate(rests):
        of = F.when(F.col("drop") == drop, rest).otherwise(of)
    keys = F.broadcast(strings.sparkSession.createDataFrame(plan, "n int, longer int, drop int"))
    return strings.join(keys, F.length("t") == F.col("n")).select("t", "longer", (F.col("n") == F.col("longer")).alias("whole"), F.explode(of).alias("rest"))


def score_rests(left: DataFrame, right: DataFrame, least: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(t, u, score), t < u, of short strings with a rest in common (rest_keys of both sides), where they are alike enough; on: what else they are joined by."""
    met = left.join(right.withColumnsRenamed({"t": "u", "whole": "whole_u"}), ["longer", "rest", *on]).where((F.col("whole") | F.col("whole_u")) & (F.col("t") != F.col("u")))
    near = met.select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")).distinct()
    return near.withColumn("score", T.levenshtein_ratio(F.col("t"), F.col("u"))).where(F.col("score") >= least)


def cut_pieces(strings: DataFrame, least: float, measure: str = "levenshtein") -> DataFrame:
    """(t, n, k, at, size, piece): each string t of n letters, cut into the k edits allowed plus one pieces."""
    n = F.length("t")
    slack = least if measure == "levenshtein" else least - 0.005
    # Edits possible against any string that is similar enough: levenshtein <= (1 - least) * longer, and longer <= n / least.
    edits = F.floor((1 - slack) * n / slack).cast("int") if measure == "levenshtein" else F.floor(2 * (1 - slack) * n / slack).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(F.floor(F.col("n") * i / (F.col("k") + 1)).cast("int").alias("at"), F.floor(F.col("n") * (i + 1) / (F.col("k") + 1)).cast("int").alias("to")))
    cut = strings.select("t", n.alias("n"), edits.alias("k")).select("t", "n", "k", F.explode(pieces).alias("p"))
    return cut.select("t", "n", "k", F.col("p.at").alias("at"), (F.col("p.to") - F.col("p.at")).alias("size"), F.expr("substring(t, p.at + 1, p.to - p.at)").alias("piece")).where("piece <> ''")


def substrings(strings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, m, place, piece): all substrings of strings (u, of m letters) of the given sizes (size), a number for each length of a piece."""
    grams = strings.join(F.broadcast(sizes), F.col("size") <= F.col("m"))
    places = F.transform(F.sequence(F.lit(0), F.col("m") - F.col("size")), lambda i: F.struct(i.alias("place"), F.substring(F.col("u"), i + 1, F.col("size")).alias("piece")))
    return grams.select("u", "m", F.explode(places).alias("g")).select("u", "m", "g.place", "g.piece")


def score_strings(pieces: DataFrame, grams: DataFrame, least: float, measure: str = "levenshtein", on: list[str] | None = None, short: int = 0) -> DataFrame:
    """(t, u, score), t < u, of strings of which one's piece stands in the other near its place, where they are alike enough; on: what pieces and substrings are joined by; short: pairs of strings of at most so many letters are left out."""
    near = pieces.join(grams, on or ["piece"]).where((F.greatest("n", "m") > short) & (F.abs(F.col("place") - F.col("at")) <= F.col("k")) & (F.abs(F.col("n") - F.col("m")) <= F.col("k")) & (F.col("t") != F.col("u"))).select(F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u")).distinct()
    score = T.levenshtein_ratio(F.col("t"), F.col("u")) if measure == "levenshtein" else T.fuzz_ratio(F.col("t"), F.col("u")) / 100
    return near.withColumn("score", score).where(F.col("score") >= least)


def set_classes(sets: DataFrame) -> DataFrame:
    """(id, class_id, items): sets (id, item) as sorted arrays, with the smallest id of those that are equal."""
    whole = sets.select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return whole.join(whole.groupBy("items").agg(F.min("id").alias("class_id")), "items").select("id", "class_id", "items")


#: Keys that a set of a few items may have; where all groups of so many items as are sure to be shared would be more, smaller groups serve.
SET_KEYS = 64


def _shared_items(n: int, m: int, least: float) -> int:
    """Items that sets of n and m items have in common at least, to be that similar."""
    return math.ceil(round(least / (1 + least) * (n + m), 9))


def _group_size(n: int, least: float) -> int:
    """How many items make a key where the larger set has n: as many as are sure to be shared, while the keys stay few."""
    sure = math.ceil(round(least * n, 9))
    return max(k for k in range(1, sure + 1) if k == 1 or math.comb(n - sure + k, k) <= SET_KEYS)


def _key_plan(sizes: list[int], least: float) -> list[tuple[bool, int, int, list[list[int]]]]:
    """(larger, n, k, groups): which places of a set of n items, the rarest first, are its keys of k items, as the larger set of a pair and as the other one."""

    def groups(count: int, k: int) -> list[list[int]]:
        return [list(g) for g in itertools.combinations(range(count), k)]

    out = []
    for n in sizes:
        k = _group_size(n, least)
        out.append((True, n, k, groups(n - math.ceil(round(least * n, 9)) + k, k)))
        shared: dict[int, int] = {}  # by k the fewest items shared with a larger set
        for other in sizes:
            if n <= other and least * other <= n + 1e-9:
                k = _group_size(other, least)
                shared[k] = min(shared.get(k, n), _shared_items(other, n, least))
        out += [(False, n, k, groups(n - least_shared + k, k)) for k, least_shared in shared.items()]
    return out


def similar_sets(sets: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, score) of classes of sets (id, item) with that Jaccard similarity (0.5 at least); a < b are the class ids of set_classes.

    Prefix filter: with items in order of rarity, two sets that must share o items share k of
    the first n - o + k of each (n: its size, k <= o). So groups of k items are the keys, k the
    larger the fewer groups there are: sets of few items are keyed by all that they must share,
    and hardly anything meets that isn't similar; those of many by few items, which are rare.
    What meets is cut by sizes, and by signatures (a bit for each item), which never miss a
    pair; with 64 items at most signatures tell the score, else it is counted from the sets.
    """
    if not 0.5 <= least < 1:
        raise ValueError("least must be 0.5 at least and below 1")
    spark = sets.sparkSession
    whole = sets.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    groups = written(whole.groupBy("items").agg(F.min("id").alias("rep")).withColumn("n", F.size("items")).where("n > 0"))
    single = groups.select("rep", F.explode("items").alias("item"))
    order = single.groupBy("item").agg(F.count("*").alias("df"))
    few = order.limit(65).collect()
    dense = len(few) <= 64
    signature = lambda items, bit: F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(x))))
    if dense:
        ranks = F.create_map(*(x for place, row in enumerate(sorted(few, key=lambda r: (r["df"], r["item"]))) for x in (F.lit(row["item"]), F.lit(place)))) if few else F.lit(None).cast("map<bigint,int>")
        rank = lambda x: F.try_element_at(ranks, x)
        ranked = F.transform(F.array_sort(F.transform("items", lambda x: F.struct(rank(x).alias("rank"), x.alias("item")))), lambda x: x["item"])
        signed = groups.select("rep", "n", ranked.alias("ranked"), signature("items", rank).alias("s"))
    else:
        ranks = single.join(order, "item").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "item"))), lambda x: x["item"]).alias("ranked"))
        signed = written(groups.join(ranks, "rep").select("rep", "n", "ranked", signature("items", lambda x: F.pmod(F.xxhash64(x), F.lit(64)).cast("int")).alias("s")))
    plan = _key_plan([r["n"] for r in groups.select("n").distinct().orderBy("n").collect()], least)  # a row for each size that occurs
    keys = F.broadcast(spark.createDataFrame(plan, "larger boolean, n int, k int, places array<array<int>>"))

    def keyed(larger: bool) -> DataFrame:
        some = signed.join(keys.where(F.col("larger") == larger), "n").select("rep", "n", "s", "k", "ranked", F.explode("places").alias("place"))
        return some.select("rep", "n", "s", F.xxhash64("k", F.transform("place", lambda i: F.get("ranked", i))).alias("key"))

    probe, index = keyed(True), keyed(False).select(F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), "key")
    smaller = (F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("rep_b") < F.col("rep")))
    near = F.col("n_b") >= F.lit(least) * F.col("n") - 1e-9
    if dense:
        common = F.bit_count(F.col("s").bitwiseAND(F.col("s_b")))
        score = common / (F.col("n") + F.col("n_b") - common)
        found = probe.join(index, "key").where(smaller & near & (score >= least)).select("rep", "rep_b", score.alias("score")).distinct()
    else:
        # An item whose bit the other signature lacks isn't in the other set.
        most = F.least(F.col("n") - F.bit_count(F.col("s").bitwiseAND(F.bitwise_not("s_b"))), F.col("n_b") - F.bit_count(F.col("s_b").bitwiseAND(F.bitwise_not("s"))))
        pairs = probe.join(index, "key").where(smaller & near & ((1 + least) * most >= least * (F.col("n") + F.col("n_b")) - 1e-9)).select("rep", "rep_b").distinct()
        left, right = groups.select("rep", "items"), groups.select(F.col("rep").alias("rep_b"), F.col("items").alias("items_b"))
        found = pairs.join(left, "rep").join(right, "rep_b").withColumn("score", T.jaccard(F.col("items"), F.col("items_b"))).where(F.col("score") >= least)
    return found.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"), "score")


def _unit(column: pd.Series) -> np.ndarray:
    m = np.array(column.tolist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _dealt(df: DataFrame, key: str, own: int, other: int, names: tuple[str, str], same: tuple[str, ...] = ()) -> DataFrame:
    """Rows in `own` blocks by a hash, each block once for every block of the other side."""
    block_of = F.pmod(F.xxhash64(key), F.lit(own)).cast("int").alias(names[0])
    return df.select(key, "vector", *same, block_of, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]))


def top_matches(queries: DataFrame, vectors: DataFrame, k: int, least: float = -1.0, same: tuple[str, ...] = (), query_block: int = 8000, block: int = 100_000) -> DataFrame:
    """(query_id, id, score): the k nearest vectors of each query by cosine, least at least, itself left out.

    same: columns of both that must be equal (filters on what a vector carries).

    queries: query_id, vector; vectors: id, vector. Both are dealt into blocks by a hash; every
    block of queries meets every block of vectors in a task of its own, which keeps k of each
    query. So each side is copied as often as the other has blocks, and no group outgrows a block.
    Within a task scores are worked out 100 by 20,000 at a time, in single precision, and those that
    may beat a query's k-th so far once more in double precision.
    """
    asked, right = queries.count(), max(-(-vectors.count() // block), 1)
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism  # as many at least, where there are queries enough
    left = max(-(-asked // query_block), min(-(-tasks // right), -(-asked // 250)), 1)
    q = _dealt(queries, "query_id", left, right, ("q", "v"), same).groupBy("q", "v", *same)
    v = _dealt(vectors, "id", right, left, ("v", "q"), same).groupBy("q", "v", *same)

    def nearest(ids: np.ndarray, m: np.ndarray, own: np.ndarray, b: np.ndarray, rough: np.ndarray) -> pd.DataFrame:
        row, found, score, floor = np.zeros(0, np.int64), own[:0], np.zeros(0), np.full(len(ids), float(least))
        slack = 1e-6 * (8 + m.shape[1])  # well above what single precision loses
        fast = m.astype(np.float32)
        for i in range(0, len(own), 20_000):
            part = fast @ rough[i : i + 20_000].T
            lowest = floor - slack
            if i == 0 and part.shape[1] > k + 1 and np.count_nonzero(part >= np.float32(least)) > 20 * (k + 1) * len(ids):
                lowest = np.maximum(lowest, np.partition(part, part.shape[1] - k - 1, axis=1)[:, -k - 1] - 2 * slack)  # one of them may be the query itself
            r, c = np.nonzero(part >= lowest[:, None].astype(np.float32))
            exact = np.einsum("ij,ij->i", m[r], b[i + c])
            # Later ids are larger, so that they lose ties with the k-th.
            better = (own[i + c] != ids[r]) & (exact >= least) & ((exact > floor[r]) | (np.bincount(row, minlength=len(ids))[r] < k))
            r, c, exact = r[better], c[better], exact[better]
            row, found, score = np.r_[row, r], np.r_[found, own[i + c]], np.r_[score, exact]
            order = np.lexsort((found, -score, row))
            row, found, score = row[order], found[order], score[order]
            starts = np.searchsorted(row, np.arange(len(ids)))
            kept = np.arange(len(row)) - starts[row] < k
            row, found, score = row[kept], found[kept], score[kept]
            full = np.bincount(row, minlength=len(ids)) == k
            floor[full] = score[np.searchsorted(row, np.flatnonzero(full), "right") - 1]
        return pd.DataFrame({"query_id": ids[row], "id": found, "score": score})

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("id", ignore_index=True)
        own, units = b["id"].to_numpy(), _unit(b["vector"])
        ids, m = a["query_id"].to_numpy(), _unit(a["vector"])
        rough = units.astype(np.float32)
        return pd.concat([nearest(ids[i : i + 100], m[i : i + 100], own, units, rough) for i in range(0, len(ids), 100)])

    hits = q.cogroup(v).applyInPandas(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def all_cosines(vectors: DataFrame, block: int = 1000) -> DataFrame:
    """(i, j, cos) of all pairs of vectors (id, vector) with i < j: two blocks at a time in a task, which holds no more than their similarities."""
    blocks = max(-(-vectors.count() // block), 1)
    # Columns of the sides are named apart: both come from the same ones.
    left = _dealt(vectors.withColumnRenamed("id", "i"), "i", blocks, blocks, ("x", "y")).withColumn("u", F.col("vector")).drop("vector").groupBy("x", "y")
    right = _dealt(vectors.withColumnRenamed("id", "j"), "j", blocks, blocks, ("y", "x")).withColumn("w", F.col("vector")).drop("vector").groupBy("x", "y")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "cos": []})
        i, j = a["i"].to_numpy(), b["j"].to_numpy()
        row, column = np.nonzero(i[:, None] < j[None, :])
        return pd.DataFrame({"i": i[row], "j": j[column], "cos": (_unit(a["u"]) @ _unit(b["w"]).T)[row, column]})

    return left.cogroup(right).applyInPandas(compare, "i long, j long, cos double")


def search_page(queries: DataFrame, vectors: DataFrame, offset: int, limit: int, least: float) -> DataFrame:
    """One page of each query's nearest vectors: query_id, id, rank (from 1 over all pages), score and match_reason. A vector id that stands twice counts with its best score."""
    hits = top_matches(queries, vectors, offset + limit, least).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    reason = F.format_string("similarity %d%%, meets all filters", F.floor(F.col("score") * 100).cast("int"))
    return hits.withColumns({"rank": rank, "match_reason": reason}).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def star(classes: DataFrame, id_col: str) -> DataFrame:
    """(a, b, score 1) of each class's smallest id and every other member, so that equal items are linked without writing all pairs."""
    return classes.where(F.col(id_col) != F.col("class_id")).select(F.col("class_id").alias("a"), F.col(id_col).alias("b"), F.lit(1.0).alias("score"))


def _both_ways(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(x, y, s): class links in both directions, and each class with itself at 1."""
    return edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("score").alias("s")).union(edges.select("b", "a", "score")).union(classes.select("class_id", "class_id", F.lit(1.0)).distinct())


def useful_set_links(sets: DataFrame, titles: DataFrame, near: DataFrame, weights: dict[str, float], least: float, similar: float = 0.7) -> DataFrame:
    """similar_sets of those classes of sets (id, class_id, items) that can matter to best_matches of the same titles, near, weights and least.

    Sets that differ are less than 1 alike. Where sets alone aren't enough then, their links count
    only with a title or vector link, so only the sets of ids that have either are compared.
    """
    if weights["ingredients"] <= least:
        asked = titles.select("id").union(near.select("a")).union(near.select("b")).distinct()
        sets = sets.join(asked, "id", "left_semi")
    return similar_sets(sets.select("class_id", "items").distinct().select(F.col("class_id").alias("id"), F.explode("items").alias("item")), similar)


def best_matches(titles: DataFrame, title_edges: DataFrame, sets: DataFrame, set_edges: DataFrame, near: DataFrame, weights: dict[str, float], least: float = 0.85) -> DataFrame:
    """(id, other, score): of each id its best match by the weighted sum of its methods' scores, if good enough; of equally good ones the smallest id.

    titles and sets: (id, class_id) of equal titles and equal sets; title_edges and set_edges:
    (a, b, score) of those classes; near: (a, b, score) of ids. An id may be missing anywhere; a
    method that doesn't link two ids counts 0.

    Pairs of members are never written out. Ids of one title class and one set class are of a
    kind. What is linked by both title and set is found from an id's kind, by all classes linked
    with its title and with its set: so many keys as the two have links, looked up among the
    kinds, however many members any class has. What is linked by one alone is the class's own
    best link. Vector links are between ids, and take in the other scores by their classes.
    """
    wt, ws, wn = (F.lit(weights[m]) for m in ("title_fuzzy", "ingredients", "embedding"))
    t, s = (written(c.select("id", F.col("class_id").alias(n))) for c, n in ((titles, "t"), (sets, "s")))
    te, se = written(_both_ways(title_edges, titles)), written(_both_ways(set_edges, sets))
    both = written(t.join(s, "id"))

    def first_two(df: DataFrame, *keys: str) -> DataFrame:
        """The two smallest ids of each group: of every member one at least is another one."""
        low = df.groupBy(*keys).agg(F.min("id").alias("first"))
        rest = df.join(low, list(keys)).where("id <> first").groupBy(*keys).agg(F.min("id").alias("second"))
        return low.join(rest, list(keys), "left")

    def chosen(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.struct("score", F.negative("other").alias("other"))).alias("best")).select(*keys, F.negative("best.other").alias("other"), "best.score")

    def by_class(members: DataFrame, edges: DataFrame, key: str, weight) -> DataFrame:
        """Best match of every member by one method alone."""
        two = first_two(members, key)
        away = edges.where((F.col("x") != F.col("y")) & (weight * F.col("s") >= least - 1e-8)).join(two.select(F.col(key).alias("y"), F.col("first").alias("other")), "y").select(F.col("x").alias(key), (weight * F.col("s")).alias("score"), "other")
        far = members.join(chosen(away, key), key).select("id", "other", "score")
        own = F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second"))
        return far.union(members.join(two, key).select("id", own.alias("other"), weight.alias("score")).where("other IS NOT NULL"))

    kinds = written(first_two(both, "t", "s"))
    wide = kinds.select("t", "s").join(te.select(F.col("x").alias("t"), F.col("y").alias("t2"), F.col("s").alias("by_t")), "t").join(se.select(F.col("x").alias("s"), F.col("y").alias("s2"), F.col("s").alias("by_s")), "s")
    there = kinds.select(F.col("t").alias("t2"), F.col("s").alias("s2"), F.col("first").alias("other"))
    linked = wide.where("t <> t2 OR s <> s2").join(there, ["t2", "s2"]).select("t", "s", (wt * F.col("by_t") + ws * F.col("by_s")).alias("score"), "other")
    by_kind = both.join(chosen(linked, "t", "s"), ["t", "s"]).select("id", "other", "score")
    alike = both.join(kinds.where("second IS NOT NULL"), ["t", "s"]).select("id", F.when(F.col("first") != F.col("id"), F.col("first")).otherwise(F.col("second")).alias("other"), (wt + ws).alias("score"))
    pairs = near.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("score").alias("n")).union(near.select("b", "a", "score"))
    for classes, edges, name in ((t, te, "t"), (s, se, "s")):
        pairs = pairs.join(classes.withColumnRenamed(name, "x"), "id", "left").join(classes.select(F.col("id").alias("other"), F.col(name).alias("y")), "other", "left")
        pairs = pairs.join(edges.withColumnRenamed("s", f"by_{name}"), ["x", "y"], "left").drop("x", "y")
    scored = pairs.select("id", "other", (wt * F.coalesce("by_t", F.lit(0.0)) + ws * F.coalesce("by_s", F.lit(0.0)) + wn * F.col("n")).alias("score"))
    every = by_class(t, te, "t", wt).union(by_class(s, se, "s", ws)).union(by_kind).union(alike).union(scored)
    return chosen(every.withColumn("score", F.round("score", 9)), "id").where(F.col("score") >= least)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of links (a, b) is connected with.

    Each id is first put together with its smallest neighbour, which leaves nothing of groups
    around one id. Labels of what is left spread to neighbours and then jump to their own label's
    label, until none changes.
    """
    both = written(_both_ends(links))
    labels = written(_least_neighbours(both))
    at = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    ends = both.where("a < b").join(at, "a").join(at.withColumnsRenamed({"a": "b", "x": "y"}), "b")
    left = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    discard(both)
    if left.isEmpty():
        return labels
    spread = _spread(left).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return labels.join(spread, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


def _both_ends(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def _least_neighbours(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component"))


def _spread(links: DataFrame) -> DataFrame:
    """(id, component) of links (a, b), by labels that spread and jump."""
    both = written(_both_ends(links))
    labels = written(_least_neighbours(both))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = written(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = new.where("old <> component").limit(1).count()
        discard(labels)
        labels = new.select("id", "component")
        if not changed:
            discard(both)
            return labels


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) of all links so far: stored labels and new links (a, b), without the old links.

    A stored component is one node, named by its smallest id; only what the new links touch is
    worked on, and the result is what components() gives for old and new links together.
    """
    at = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    ends = links.select("a", "b").join(at, "a", "left").withColumn("x", F.coalesce("x", "a"))
    ends = ends.join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left").withColumn("y", F.coalesce("y", "b"))
    ends = written(ends.select("a", "b", "x", "y"))
    moved = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("to"))
    new = ends.select(F.col("a").alias("id"), F.col("x").alias("component")).union(ends.select("b", "y")).join(labels, "id", "left_anti").distinct()
    return labels.select("id", "component").union(new).join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


#: Letters of which the order of rarity is kept; all others count as rarer than these.
RANKED_LETTERS = 5000


def _letter_ranks(strings: DataFrame) -> dict[tuple[str, int], int]:
    """Ranks of (letter, i), the i-th time that a letter stands in a string (s), by the number of strings that have it, the rarest first."""
    letters = F.split("s", "")
    times = F.transform(F.array_distinct("letters"), lambda x: F.struct(x.alias("letter"), (F.size("letters") - F.size(F.array_remove("letters", x))).alias("times")))
    counts = strings.select(letters.alias("letters")).select(F.explode(times).alias("x")).groupBy("x.letter", "x.times").agg(F.count("*").alias("n"))
    having: dict[tuple[str, int], int] = {}
    for letter, most, n in counts.orderBy(F.desc("n"), "letter", "times").limit(RANKED_LETTERS).collect():
        for i in range(1, most + 1):
            having[letter, i] = having.get((letter, i), 0) + n
    return {x: rank for rank, x in enumerate(sorted(having, key=lambda x: (having[x], x)))}


def alike_candidates(items: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """(s, u): pairs of distinct strings of items (s) and names (u) that may have a fuzz ratio of least (above 0); no pair that has is missing.

    A common subsequence has no more letters than the two strings' letters have in common, each
    counted as often as it stands. So a string is taken as the set of its numbered letters, for
    which a ratio asks a Jaccard similarity, and keys are made of the rarest ones as in
    similar_sets: the longer string's and the shorter one's, and items may be either. What
    meets is cut by signatures of 128 bits, a bit for each numbered letter: a letter whose bit the
    other signature lacks isn't in the other string.
    """
    ratio = (least - 0.5) / 100
    if ratio <= 0:
        raise ValueError("least must be above 0")
    jaccard = ratio / (2 - ratio)
    both = items.select("s").union(names.select(F.col("u").alias("s"))).where("s <> ''")
    sizes = [r["n"] for r in both.select(F.length("s").alias("n")).distinct().orderBy("n").collect()]  # a row for each length that occurs
    plan: dict[tuple[bool, int], list[tuple[int, list[list[int]]]]] = {}
    for larger, n, k, groups in _key_plan(sizes, jaccard):
        plan.setdefault((larger, n), []).append((k, groups))
    ranks = _letter_ranks(both)

    def keys(name: str, of_items: bool):
        def make(batches):
            for batch in batches:
                rows = []
                for text in batch[name]:
                    seen: dict[str, int] = {}
                    numbered = []
                    for ch in text:
                        seen[ch] = seen.get(ch, 0) + 1
                        numbered.append((ranks.get((ch, seen[ch]), -1), ch, seen[ch]))
                    numbered.sort()
                    bits = 0
                    for rank, ch, i in numbered:
                        bits |= 1 << (rank if rank >= 0 else ord(ch) + 7 * i) % 128
                    low, high = ((b & (1 << 63) - 1) - (b & 1 << 63) for b in (bits & (1 << 64) - 1, bits >> 64))
                    for larger in (True, False):
                        for k, groups in plan[larger, len(text)]:
                            rows += [(text, len(text), low, high, larger == of_items, f"{k} " + " ".join(f"{numbered[i][1]}{numbered[i][2]}" for i in g)) for g in groups]
                yield pd.DataFrame(rows, columns=[name, "n", "low", "high", "item_longer", "key"])

        return make

    columns = "n int, low long, high long, item_longer boolean, key string"
    left = items.where("s <> ''").select("s").mapInPandas(keys("s", True), f"s string, {columns}")
    right = names.where("u <> ''").select("u").mapInPandas(keys("u", False), f"u string, {columns}").withColumnsRenamed({"n": "m", "low": "low_u", "high": "high_u"})

    def lacking(a: str, b: str) -> Column:
        return F.bit_count(F.col(f"low{a}").bitwiseAND(F.bitwise_not(f"low{b}"))) + F.bit_count(F.col(f"high{a}").bitwiseAND(F.bitwise_not(f"high{b}")))

    most = F.least(F.col("n") - lacking("", "_u"), F.col("m") - lacking("_u", ""))
    met = left.join(right, ["key", "item_longer"]).where((F.col("item_longer") == (F.col("m") <= F.col("n"))) & (most >= F.lit(ratio / 2) * (F.col("n") + F.col("m")) - 1e-9))
    return met.select("s", "u").distinct()


def most_alike(items: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """(item_l, name_id, score): for each item_l of items the name of names (name_l, name_id) with the highest fuzz ratio, least (above 0) at least.

    Equally alike names: the smallest id. Null and empty strings are like nothing. Only
    candidates that have enough letters in common are scored.
    """
    known = names.where("name_l <> ''").groupBy("name_l").agg(F.min("name_id").alias("name_id"))
    near = alike_candidates(items.select(F.col("item_l").alias("s")).distinct(), known.select(F.col("name_l").alias("u")), least)
    scored = near.select("s", "u", T.fuzz_ratio(F.col("s"), F.col("u")).alias("score")).where(F.col("score") >= least).join(known, F.col("u") == F.col("name_l"))
    return scored.groupBy(F.col("s").alias("item_l")).agg(F.max(F.struct("score", F.negative("name_id").alias("id"))).alias("best")).select("item_l", F.negative("best.id").alias("name_id"), "best.score")


def fuzzy_lookup(items: DataFrame, master: DataFrame, least: int = 70) -> DataFrame:
    """(item, ingredient_id, how, score): by name, else by synonym, else by the most alike name.

    items: distinct item strings (item). Ties go to the smallest ingredient id.
    """
    names = master.groupBy(F.lower("standard_name").alias("item_l")).agg(F.min("ingredient_id").alias("by_name"))
    synonyms = master.groupBy(F.lower("synonym").alias("item_l")).agg(F.min("ingredient_id").alias("by_synonym"))
    s = written(items.select("item", F.lower("item").alias("item_l")).join(names, "item_l", "left").join(synonyms, "item_l", "left"))
    rest = s.where("by_name IS NULL AND by_synonym IS NULL").select("item_l").distinct()
    close = most_alike(rest, names.select(F.col("item_l").alias("name_l"), F.col("by_name").alias("name_id")), least).select("item_l", F.col("name_id").alias("by_likeness"), "score")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_synonym").isNotNull(), "synonym").when(F.col("by_likeness").isNotNull(), "fuzzy").otherwise("none")
    score = F.coalesce(F.when(F.coalesce("by_name", "by_synonym").isNotNull(), 100), "score")
    return s.join(close, "item_l", "left").select("item", F.coalesce("by_name", "by_synonym", "by_likeness").alias("ingredient_id"), how.alias("how"), score.alias("score"))
