"""Near-duplicates (operator 3): one-permutation MinHash with star-shaped candidates.

One hash of each shingle fills the bins of a sketch; an empty bin borrows from the first
non-empty bin in an order of its own (optimal densification). Bands of bins are bucket keys.
Every two sets of a bucket end up linked through others, or compared:

1. Stars: every set is compared with the hub of its fullest bucket, then, in the buckets that
   hold several components still, with the hub of each. A bucket with n sets gives n - 1 pairs.
2. In a bucket that still holds several components, the sets outside its largest one are
   compared with all others: as pairs where they are few, else block by block in tasks, which
   emit the links only. Nothing ends this early, and no pair is left out but by bounds that no
   pair of enough similarity misses (sizes, and bitmaps of the sets).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.operators.similarity import components

from .shared import discard, frugal, mix, shingle_sets, steps, table, text_bytes, written

#: A band of ROWS bins agrees with probability J^ROWS; of BANDS bands none does with (1 - J^ROWS)^BANDS: at J = 0.8 0.000003.
ROWS, BANDS = 6, 42
BINS = 256
#: Sets outside a bucket's largest component that are few enough for a pair with each other member.
FEW = 4
#: Sets, and shingles of them, that one side of a block comparison holds, about.
BLOCK_SETS, BLOCK_SHINGLES = 512, 4_000_000
#: Ids that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Longs of a set's bitmap, whose bits are the leading 10 bits of its hashes.
LONGS = 16


def _orders() -> np.ndarray:
    """For each bin the order in which it looks at the others, a random permutation."""
    keys = mix((np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(BINS, dtype=np.uint64) + np.uint64(1))
    return np.argsort(keys, axis=1, kind="stable")


ORDERS = _orders()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS minima for each set of sorted hashes (empty sets: zeros)."""
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    for i, hashes in enumerate(sets):
        if len(hashes):
            at = np.searchsorted(hashes, edges)
            low = hashes[np.minimum(at, len(hashes) - 1)]
            filled[i] = (at < len(hashes)) & (low >> np.uint64(56) == edges >> np.uint64(56))
            out[i] = low
    for i in np.flatnonzero(~filled.all(1) & filled.any(1)):
        open_bins = np.flatnonzero(~filled[i])
        lender = ORDERS[open_bins, filled[i][ORDERS[open_bins]].argmax(1)]
        out[i, open_bins] = out[i, lender]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None] << np.uint64(40), len(sketch), 0)
    for j in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j : j + ROWS * BANDS : ROWS])
    return keys.view(np.int64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of LONGS longs for each set: bit k is set if a hash falls into the k-th part of the 64-bit range."""
    out = np.zeros((len(sets), 64 * LONGS), bool)
    for row, hashes in zip(out, sets):
        row[hashes >> np.uint64(64 - (64 * LONGS - 1).bit_length())] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """id, n (size of the shingle set), same (128-bit hash of the set), bands and bitmap of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                keys = band_keys(sketches(sets))
                ends = np.arange(len(sets) + 1, dtype=np.int32) * BANDS
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel())), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * LONGS), pa.array(bitmaps(sets).ravel()))], names=["id", "n", "same", "bands", "bits"])

    return docs.mapInArrow(frugal(run), "id long, n long, same binary, bands array<long>, bits array<long>")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of the documents of ids (id), without a shuffle of the others where these are few."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    texts = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs)
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a_offsets, a_data = text_bytes(batch.column(2))
            b_offsets, b_data = text_bytes(batch.column(3))
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for s, e in steps(b_offsets):
                sets = shingle_sets(b_data[b_offsets[s] : b_offsets[e]], b_offsets[s : e + 1] - b_offsets[s], width)
                for i in range(s, e):
                    text = a_data[a_offsets[i] : a_offsets[i + 1]]
                    key = (left[i], len(text), text.tobytes())
                    if key != last[0]:
                        last = (key, shingle_sets(text, np.array([0, len(text)]), width)[0])
                    x, y = last[1], sets[i - s]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common and 100 * common >= percent * (len(x) + len(y) - common):
                        good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in good], pa.int64()), pa.array([right[i] for i in good], pa.int64())], names=["a", "b"])

    return both.mapInArrow(frugal(run), "a long, b long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the sorted shingle hashes (as bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(1))
            for s, e in steps(offsets):
                sets = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "hashes"])

    return docs.select("id", "text").mapInArrow(frugal(run), "id long, hashes binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left and right sets, as products of 0/1 matrices over `columns` shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    rows = []
    for values, sets in ((x, left), (y, right)):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        some = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[some], kind="stable")
        rows.append((of[some][order], at[some][order]))
    for low in range(0, len(shared), columns):
        width = min(columns, len(shared) - low)
        parts = []
        for (of, at), n in zip(rows, (len(left), len(right))):
            a, b = np.searchsorted(at, [low, low + width])
            part = np.zeros((n, width), np.float32)
            part[of[a:b], at[a:b] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _block_links(rest: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of rest (bucket, id, n, component, outer, members, shingles): each outer member with all members of other components.

    A bucket's members are dealt into blocks by a hash; every block of outer ones meets every
    block of members in a group of its own.
    """
    full = written(rest.join(_sets(_texts_of(rest.select("id"), docs), width), "id"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = full.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    key = ["bucket", "l", "r"]
    left = dealt.where("outer").select("bucket", F.col("own").alias("l"), other.alias("r"), "id", "component", "hashes").groupBy(*key)
    right = dealt.select("bucket", F.col("own").alias("r"), other.alias("l"), "id", "component", "hashes").groupBy(*key)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        (ids_a, part_a, sets_a), (ids_b, part_b, sets_b) = (
            (t["id"].to_numpy(), t["component"].to_numpy(), [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()]) for t in (a, b)
        )
        common = common_counts(sets_a, sets_b)
        total = np.array([len(s) for s in sets_a])[:, None] + np.array([len(s) for s in sets_b])[None, :]
        i, j = np.nonzero((100 * common >= percent * (total - common)) & (part_a[:, None] != part_b[None, :]))
        return pa.table({"a": pa.array(np.minimum(ids_a[i], ids_b[j]), pa.int64()), "b": pa.array(np.maximum(ids_a[i], ids_b[j]), pa.int64())})

    return left.cogroup(right).applyInArrow(compare, "a long, b long").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, component) after further links (a, b): only the components that these join are worked on."""
    of = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    ends = links.join(of, "a", "left").select("b", F.coalesce("x", "a").alias("x")).join(of.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left").select(F.col("x").alias("a"), F.coalesce("y", "b").alias("b"))
    lower = components(ends.where("a <> b"))
    moved = labels.join(lower.select(F.col("id").alias("component"), F.col("component").alias("lowest")), "component", "left").select("id", F.coalesce("lowest", "component").alias("component"))
    return written(moved.union(lower.join(labels, "id", "left_anti").select("id", "component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Rows are linked when their sets of `width`-word shingles (A-Z as a-z; with fewer words the
    whole sequence as one) have a Jaccard similarity of percent / 100 or more. component_id is
    the smallest id reachable, kept says that it is the row's own. Sets are compared whole, by
    64-bit hashes of their shingles.

    Null and empty texts have no shingles and no links; a row with a null id has no links, a
    null component and is kept; the texts of rows that repeat an id count as one document's.
    Other columns of docs are not looked at, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(_sketched(docs, width))
    linked = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    # Equal sets are one from here on: the smallest id stands for them.
    first = linked.groupBy("same").agg(F.min(F.struct("id", "n", "bands", "bits")).alias("first"), F.count("*").alias("rows"))
    distinct = written(first.select("same", "first.id", "first.n", "first.bands", "first.bits", "rows"))
    copies = linked.select("same", "id").join(distinct.where("rows > 1").select("same", F.col("id").alias("first")), "same").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))

    banded = distinct.select("id", "n", F.explode("bands").alias("bucket"))
    # What is found for each bucket is written before it is joined by bucket: Spark then splits a hot one among tasks.
    several = written(banded.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1"))
    crowded = written(banded.join(several, "bucket"))  # buckets of one set are gone
    # How many sets a set meets in its buckets: the original of many copies meets the most, which makes it the hub.
    own = crowded.groupBy("id").agg(F.sum("sets").alias("met"), F.max(F.struct("sets", "bucket")).alias("fullest"))
    members = written(crowded.join(own, "id").select("bucket", "id", "n", "met", (F.col("fullest.bucket") == F.col("bucket")).alias("is_fullest")))
    discard(crowded, several)

    def alike(n: Column, m: Column) -> Column:
        return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)

    # A part of the hash range that only one of two sets reaches has a shingle that only this one has.
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_a")[k])) for k in range(LONGS)), F.lit(0))
    near = alike(F.col("n"), F.col("n_a")) & (F.lit(100 + percent) * (F.col("n") + F.col("n_a") - apart) >= F.lit(2 * percent) * (F.col("n") + F.col("n_a")))
    as_pair = (F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))

    # Stars, by the fullest bucket of each set.
    hubs = written(members.groupBy("bucket").agg(F.max(F.struct("met", F.negative("id").alias("id"), "n")).alias("hub")).select("bucket", F.negative("hub.id").alias("a"), F.col("hub.n").alias("n_a")))
    star = members.where("is_fullest").join(hubs, "bucket").where((F.col("id") != F.col("a")) & alike(F.col("n"), F.col("n_a")))
    tried = written(star.select(*as_pair).distinct())
    discard(hubs)
    labels = components(_confirmed(tried, docs, width, percent))

    def still_open(of: DataFrame, columns: list[str]) -> DataFrame:
        """Members of the buckets that hold several components, with these."""
        marked = of.select("bucket", "id", *columns).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        split = written(marked.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket"))
        return marked.join(split, "bucket", "left_semi")

    # Stars in all buckets that are open.
    left = written(still_open(members, ["n", "met"]).join(distinct.select("id", "bits"), "id"))
    discard(members)
    hubs = left.groupBy("bucket").agg(F.max(F.struct("met", F.negative("id").alias("id"), "n", "component", "bits")).alias("hub"))
    hubs = written(hubs.select("bucket", F.negative("hub.id").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.component").alias("part"), F.col("hub.bits").alias("bits_a")))
    star = left.join(hubs, "bucket").where((F.col("component") != F.col("part")) & near)
    pairs = written(star.select(*as_pair).distinct().join(tried, ["a", "b"], "left_anti"))
    labels = _joined(labels, _confirmed(pairs, docs, width, percent))
    tried = tried.union(pairs)

    # What is left in open buckets: all that are outside the largest component against all.
    marked = written(still_open(left, ["n", "bits"]))
    discard(left)
    parts = marked.groupBy("bucket", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    counts = parts.groupBy("bucket").agg(F.max(F.struct("size", F.negative("component").alias("component"))).alias("top"), F.sum("size").alias("members"), F.sum("shingles").alias("shingles"))
    counts = written(counts.select("bucket", F.negative("top.component").alias("largest"), "members", "shingles", (F.col("members") - F.col("top.size")).alias("outside")))
    rest = written(marked.join(counts, "bucket").withColumn("outer", F.col("component") != F.col("largest")).drop("largest"))
    few = rest.where(F.col("outside") <= FEW)
    centres = few.where("outer").select("bucket", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("part"), F.col("bits").alias("bits_a"))
    pairs = few.join(centres, "bucket").where((F.col("component") != F.col("part")) & near)
    pairs = written(pairs.select(*as_pair).distinct().join(tried, ["a", "b"], "left_anti"))
    found = _confirmed(pairs, docs, width, percent)
    many = rest.where(F.col("outside") > FEW).select("bucket", "id", "n", "component", "outer", "members", "shingles")
    if many.limit(1).count():
        found = found.union(_block_links(many, docs, width, percent))
    labels = _joined(labels, found)

    # Copies of a set go where its smallest id goes.
    of_sets = distinct.select("id").join(labels, "id", "left").select(F.col("id").alias("first"), F.coalesce("component", "id").alias("component"))
    of_copies = copies.join(of_sets, copies["a"] == of_sets["first"]).select(F.col("b").alias("id"), "component")
    every = labels.union(of_copies).groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select("id", "n").join(every, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates by 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) ELSE w END AS s FROM w),
f AS (SELECT s.doc_id, list_sort(s.s) AS s, len(s.s) AS n FROM s),
g AS (SELECT s, n, min(doc_id) AS rep FROM f WHERE n > 0 GROUP BY s, n),
e AS (SELECT a.rep AS a, b.rep AS b, len(list_intersect(a.s, b.s)) AS c, a.n + b.n AS t FROM g a JOIN g b ON a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM e WHERE 100 * c >= 80 * (t - c)),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS c FROM g UNION SELECT d.b, r.c FROM r JOIN d ON d.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_shingles, coalesce(m.c, f.doc_id) AS component_id, f.doc_id = coalesce(m.c, f.doc_id) AS kept
FROM f LEFT JOIN g ON f.s = g.s AND f.n > 0 LEFT JOIN m ON m.id = g.rep
"""
