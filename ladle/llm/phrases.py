"""Phrase mining (operator 11): an FM-index per shard over word ids, extended in both directions.

Texts are dealt into shards; each gets one bidirectional FM-index, the transforms of its word
sequence and of the reversed one, sorted to as many words as a phrase may have. A phrase is an
interval in both. Level by level every shard extends the intervals of the phrases that are
frequent over all shards by a word to the right and by one to the left; what both ways give has a
frequent prefix and a frequent suffix. Its counts are summed across shards, and the shards go on
from what is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import _GOLD, discard, lower, mix, slice_hashes, steps, table, text_bytes, written

#: Words of a shard, about; a shard holds one text at least. The index of so many takes some 100 MB while it is built.
SHARD_WORDS = 1_200_000
#: A shard's number and a place in it share 64 bits.
PLACE_BITS = 32
NO_LANG = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[32, 9]] = True
_SHARDS = "shard long, forward binary, backward binary, lang string, word string, place long, n long"
_FOUND = "prefix long, suffix long, place long, span long"


# --- one shard ---------------------------------------------------------------------------------


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and whether a piece begins with the word; texts share no piece."""
    inside = ~_OUTSIDE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    begin, finish = offsets[:-1][some], offsets[1:][some] - 1
    first[begin], last[finish] = inside[begin], inside[finish]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.append(0, np.cumsum(_BREAK[data], dtype=np.int32))
    piece = np.ones(len(start), bool)
    piece[1:] = breaks[start[1:]] > breaks[end[:-1]]
    piece[np.searchsorted(start, begin)[np.searchsorted(start, begin) < len(start)]] = True
    return start, end, piece


def suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes, sorted by their first `depth` symbols (by prefix doubling)."""
    rank, reach = symbols.astype(np.int64), 1
    order = np.argsort(rank)
    while reach < depth:
        step = min(reach, depth - reach)
        key = rank * (int(rank.max()) + 1)
        key[:-step] += rank[step:]
        order = np.argsort(key)
        key = key[order]
        rank[order[0]] = 0
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1])
        reach += step
    return order


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix (the last one before the first), in the suffixes' order."""
    return symbols[suffixes(symbols, depth) - 1]


def packed(values: np.ndarray) -> bytes:
    """Four planes of bytes, of which the upper ones are nearly empty and compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def by_symbol(bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols in order, and for each the place in bwt: entry r is the place whose extension by its symbol is suffix r."""
    key = (bwt.astype(np.int64) << 32) | np.arange(len(bwt))
    key.sort()
    return key >> 32, key & 0xFFFFFFFF


def extended(bwt: np.ndarray, lo: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All extensions of disjoint intervals [lo, lo + size) of bwt by one symbol that isn't 0.

    Returns which interval is extended, where its extension begins, where that begins in the
    other direction's order (the interval itself begins at `other` there), and its size.
    """
    owner = np.full(len(bwt), -1, np.int32)
    which = np.repeat(np.arange(len(lo), dtype=np.int32), size)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    owner[np.repeat(lo, size) + inner] = which
    symbols, places = by_symbol(bwt)
    owners = owner[places]
    at = np.flatnonzero((owners >= 0) & (symbols > 0))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    head = np.ones(len(at), bool)
    head[1:] = (owners[at[1:]] != owners[at[:-1]]) | (symbols[at[1:]] != symbols[at[:-1]])
    head = np.flatnonzero(head)
    count = np.diff(np.append(head, len(at)))
    begin, of = at[head], owners[at[head]].astype(np.int64)
    # In the other direction an interval has first what ends it, then its extensions by rising symbol.
    order = np.argsort(of, kind="stable")
    run = np.cumsum(count[order]) - count[order]
    opens = np.append(True, of[order][1:] != of[order][:-1])
    within = run - np.repeat(run[opens], np.diff(np.append(np.flatnonzero(opens), len(order))))
    ended = size - np.bincount(of, count, len(lo)).astype(np.int64)
    there = np.empty(len(of), np.int64)
    there[order] = other[of[order]] + ended[of[order]] + within
    return of, begin, there, count


class Shard:
    """Gathers words of texts until there are enough for an index."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.words, self.size = depth, [], 0, 0
        self.langs: dict[str, int] = {}

    def add(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        data = lower(data)
        start, end, piece = word_bounds(data, offsets)
        of = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        lang = of[np.searchsorted(offsets, start, "right") - 1] if len(start) else np.zeros(0, np.int32)
        keys = mix(slice_hashes(data, start, end) + (lang + 1).astype(np.uint64) * _GOLD)
        self.parts.append((data, (start + self.size).astype(np.int32), (end - start).astype(np.int32), piece, keys, lang))
        self.words += len(start)
        self.size += len(data)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The index, then each distinct word with its interval and count."""
        data, start, length, piece, keys, lang = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.words, self.size = [], 0, 0
        _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        frequent = np.argsort(-count, kind="stable")  # small ids for frequent words
        ids = np.empty(len(count), np.int64)
        ids[frequent] = np.arange(1, len(count) + 1)
        text = np.zeros(len(keys) + int(piece.sum()) + 1, np.int32)
        text[np.arange(len(keys)) + np.cumsum(piece)] = ids[inverse]
        first, count = first[frequent], count[frequent]
        lo = len(text) - len(keys) + np.cumsum(count) - count
        start, length, lang = start[first].astype(np.int64), length[first], np.array(list(self.langs), object)[lang[first]]
        del keys, inverse, piece, ids
        schema = pa.schema([("shard", pa.int64()), ("forward", pa.binary()), ("backward", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("place", pa.int64()), ("n", pa.int64())])
        both = [packed(transform(text, self.depth)), packed(transform(text[::-1], self.depth))]
        yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([b], pa.binary()) for b in both), *(pa.nulls(1, t) for t in schema.types[3:])], schema=schema)
        for a in range(0, len(first), 50_000):
            n, at = len(first[a : a + 50_000]), slice(a, a + 50_000)
            word = pa.array([data[i : i + k].tobytes() for i, k in zip(start[at].tolist(), length[at].tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(lang[at], pa.string()), word, pa.array((number << PLACE_BITS) | lo[at]), pa.array(count[at])], schema=schema)


# --- all shards --------------------------------------------------------------------------------


def shards(docs: DataFrame, text_col: str, lang_col: str, depth: int, words: int) -> DataFrame:
    """Indexes (shard, forward, backward) and words (lang, word, place, n) of each shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made = Shard(depth), 0
        for batch in batches:
            part, (offsets, data), langs = batch.column(2)[0].as_py(), text_bytes(batch.column(0)), batch.column(1).to_pylist()
            for a, b in steps(offsets):
                shard.add(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b])
                if shard.words >= words:
                    yield from shard.rows((part << 11) + made)
                    made += 1
                    if made == 1 << 11:
                        raise ValueError("a partition of over 2,048 shards; read smaller partitions")
        if shard.words:
            yield from shard.rows((part << 11) + made)

    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.spark_partition_id().alias("part"))
    return texts.mapInArrow(build, _SHARDS)


def _count(span: str = "span"):
    return F.col(span).bitwiseAND(0xFFFFFFFF)


def frequent(found: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows of shards of which all shards together have `least` by key, with total and the phrase's id: its smallest place."""
    w = Window.partitionBy(*key)
    return found.select(*key, "place", "span", F.sum(_count()).over(w).alias("total"), F.min("place").over(w).alias("id")).where(F.col("total") >= least)


def longer(indexes: DataFrame, known: DataFrame) -> DataFrame:
    """Phrases, one word longer, whose prefix and suffix are known; known: place, span and id of a shard's phrases."""

    def extend(index: pa.Table, phrases: pa.Table) -> pa.Table:
        place, span, ids = (phrases.column(c).to_numpy() for c in ("place", "span", "id"))
        if not len(place) or not len(index):
            return pa.table({c: pa.array([], pa.int64()) for c in ("prefix", "suffix", "place", "span")})
        shard = (place[0] >> PLACE_BITS) << PLACE_BITS
        lo, other, size = place - shard, span >> 32, span & 0xFFFFFFFF
        forward, backward = (unpacked(index.column(c)[0].as_py()) for c in ("forward", "backward"))
        prefix, right_other, right, n = extended(backward, other, lo, size)
        suffix, left, _, _ = extended(forward, lo, other, size)
        # Phrases of one length are equal where their intervals begin alike.
        begin, x, y = np.intersect1d(right, left, assume_unique=True, return_indices=True)
        return pa.table({"prefix": ids[prefix[x]], "suffix": ids[suffix[y]], "place": shard | begin, "span": (right_other[x] << 32) | n[x]})

    ready = known.select((F.shiftright("place", PLACE_BITS)).alias("shard"), "place", "span", "id")
    return indexes.groupBy("shard").cogroup(ready.groupBy("shard")).applyInArrow(extend, _FOUND)


def ranked(df: DataFrame, group: str, order: list, top: int, rank_col: str = "rank") -> DataFrame:
    """The first `top` rows of each group in that order, numbered from 1, by one sort over all partitions: no group has to fit in a task."""
    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_row", F.monotonically_increasing_id())
    ordered = written(ordered)
    part = F.shiftright("_row", 33).alias("_part")
    runs = ordered.groupBy(group, part).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", before.alias("_before"), "_first").where(F.col("_before") < top).select(group, "_part", (F.col("_before") - F.col("_first")).alias("_shift"))
    found = ordered.withColumn("_part", part).join(runs, [group, "_part"]).withColumn(rank_col, F.col("_row") + F.col("_shift") + 1)
    return found.where(F.col(rank_col) <= top).drop("_row", "_part", "_shift")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, longest, left_extensions, right_extensions) of phrases of 2 to most_words words.

    A phrase occurs `a` times, at least `least` times, among the n words of its language, not
    across pieces. l and r count the parts of its lowest-scoring cut, score is
    floor(1000 * a * n / (l * r)). longest: no longer phrase that holds it occurs as often.
    left_extensions and right_extensions tell how many phrases have one word more on that side
    (0 at most_words). Null and empty texts have no word; a null language counts as `und`;
    repeated rows count each; all other columns are left alone. A text is read whole and is
    held by one task.
    """
    every = written(shards(docs, text_col, lang_col, most_words, shard_words), "zstd")
    words, indexes = every.where("word IS NOT NULL"), every.where("forward IS NOT NULL").select("shard", "forward", "backward")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    # A word's interval begins at the same place in both orders.
    span = F.shiftleft(F.col("place").bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col("n"))
    keys, found, levels, used = ["lang", "word"], words.select("lang", "word", "place", span.alias("span")), [], [every]
    for size in range(1, most_words + 1):
        level = written(frequent(found, keys, least))
        used.append(level)
        levels.append(level.where("place = id").select("id", *keys, F.col("total").alias("a")))
        keys, found = ["prefix", "suffix"], longer(indexes, level)
    nothing = F.array().cast("array<bigint>")
    part = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", nothing.alias("firsts"), nothing.alias("rests"))
    out = None
    for size, level in enumerate(levels[1:], 2):
        head = part.select(F.col("id").alias("prefix"), "lang", "phrase", F.concat("firsts", F.array("a")).alias("firsts"))
        tail = part.select(F.col("id").alias("suffix"), "last", F.concat(F.array("a"), F.col("rests")).alias("rests"))
        part = level.join(head, "prefix").join(tail, "suffix").select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "firsts", "rests")
        part = written(part)
        used.append(part)
        more = part.select("id", "lang", "phrase", "a", "firsts", "rests", F.lit(size).alias("words"))
        if size < most_words:
            sides = levels[size].select(F.col("prefix").alias("id"), "a", F.lit(0).alias("left"), F.lit(1).alias("right")).union(levels[size].select("suffix", "a", F.lit(1), F.lit(0)))
            sides = sides.groupBy("id").agg(F.max("a").alias("most"), F.sum("left").alias("left_extensions"), F.sum("right").alias("right_extensions"))
            more = more.join(sides, "id", "left")
        else:
            more = more.withColumns({c: F.lit(None).cast("long") for c in ("most", "left_extensions", "right_extensions")})
        out = more if out is None else out.unionByName(more)
    out = out.join(written(total), "lang")
    score = "CAST((CAST(1000 AS DECIMAL(38, 0)) * a * n) div (CAST(firsts[i] AS DECIMAL(38, 0)) * rests[i]) AS BIGINT)"
    best = F.expr(f"array_min(transform(sequence(0, words - 2), i -> struct({score} AS score, i AS cut, firsts[i] AS l, rests[i] AS r)))")
    out = out.withColumn("best", best).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score", (F.coalesce("most", F.lit(0)) < F.col("a")).alias("longest"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left_extensions", "right_extensions")))
    out = written(out)
    discard(*used)
    return out


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases that no longer one stands for (null texts have none, null languages are `und`, null ids don't matter)."""
    found = phrases(table(spark, sf_dir, "documents").select("text", "lang")).where("longest")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return ranked(found.select("lang", "phrase", "a", "l", "r", "n", "score"), "lang", order, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
o AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS g FROM w WHERE len(w) > 0),
f AS (SELECT lang, g, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, len(g))) AS k FROM c),
s AS (SELECT k.lang, k.g, k.a, k.k, x.f AS l, y.f AS r, n.n, (CAST(1000 AS HUGEINT) * a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
FROM k JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k.k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k.k + 1:] JOIN n ON n.lang = k.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS i FROM s),
inner_ AS (SELECT lang, g, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS part, a FROM c WHERE len(g) > 2),
held AS (SELECT lang, part, max(a) AS most FROM inner_ GROUP BY 1, 2),
r AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score FROM b LEFT JOIN held ON held.lang = b.lang AND held.part = b.g WHERE b.i = 1 AND (held.most IS NULL OR 100 * held.most < 100 * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z WHERE rank <= 2000
"""
