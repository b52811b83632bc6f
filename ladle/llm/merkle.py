"""Document fingerprints (operator 4): Merkle trees over paragraphs and sections.

DataFrame functions only. Sections are split at empty lines, paragraphs at line ends. A
paragraph's hash covers its text, a section's hash its paragraphs' hashes, the root the
sections' hashes; so equal roots mean equal texts, and differing branches locate edits. A
paragraph also carries the hashes of its sentences (cut to 24 code points), by which two
fingerprints are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: A sentence: as few code points as end in sentence marks or the paragraph's end, or else 24.
SENTENCE = r"(?s).{1,24}?(?:[.!?]+[ \t\n\f\r]*|\z)|.{24}"
#: Documents are sorted in buckets of consecutive ids, of about BUCKET_ROWS each: QUANTILES quantiles of the ids, each with as many quantiles of its own at most.
QUANTILES, BUCKET_ROWS = 256, 2000


def fingerprint(text: Column) -> Column:
    """array<struct<hash, paragraphs: array<struct<hash, sentences: array<string>>>>>: the sections of a text. Null counts as empty.

    Hashes of sections and paragraphs are SHA-256; of a sentence's the first 8 digits of MD5 are kept.
    """

    def paragraph(p: Column) -> Column:
        sentences = F.transform(F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)), lambda x: F.substring(F.md5(x.cast("binary")), 1, 8))
        return F.struct(F.sha2(p.cast("binary"), 256).alias("hash"), sentences.alias("sentences"))

    trees = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))
    return F.transform(trees, lambda ps: F.struct(_node(ps).alias("hash"), ps.alias("paragraphs")))


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), "").cast("binary"), 256)


def root(sections: Column) -> Column:
    return _node(sections)


def encoded(sections: Column) -> Column:
    """The fingerprint as a string: root=section{paragraph(sentences)...}..., the hashes of sections and paragraphs cut to 16 digits.

    It holds all that two fingerprints are compared by.
    """

    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["hash"], 1, 16), F.lit("("), F.array_join(p["sentences"], ""), F.lit(")"))

    def section(s: Column) -> Column:
        return F.concat(F.substring(s["hash"], 1, 16), F.lit("{"), F.array_join(F.transform(s["paragraphs"], paragraph), ""), F.lit("}"))

    return F.concat(root(sections), F.lit("="), F.array_join(F.transform(sections, section), ""))


def sentences(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["sentences"])))))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common share of the distinct sentences of two fingerprints, 0 to 1; 1 if neither has any."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Places (section, paragraph; from 0) at which fingerprint b has another branch than a, or one that a hasn't."""

    def places(s: Column, i: Column) -> Column:
        other = F.get(a, i)
        inner = F.transform(s["paragraphs"], lambda p, j: F.when(~p["hash"].eqNullSafe(F.get(other["paragraphs"], j)["hash"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(~s["hash"].eqNullSafe(other["hash"]), F.filter(inner, lambda x: x.isNotNull()))

    return F.flatten(F.filter(F.transform(b, places), lambda x: x.isNotNull()))


def with_next(docs: DataFrame, id_col: str, text_col: str, next_col: str = "next_text") -> DataFrame:
    """docs with the text of the next row by descending id; after the last row comes the first.

    Null ids come last, rows of equal id by the hash of their texts. A column named next_col is
    replaced, all others stay, whatever their names. Rows are dealt into buckets of consecutive
    ids (quantiles of the ids, and quantiles within each of these), every bucket is sorted by
    itself, and the first row of each bucket is copied to the end of the one before it. The
    bounds, QUANTILES * QUANTILES at most, are all that is broadcast, QUANTILES reach the driver.
    """
    keep = docs.drop(next_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = keep.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in keep.columns)).alias("row"), key.alias("key"))
    at = keyed.agg(F.percentile_approx("key", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("at"), F.count("*").alias("n")).first()
    bounds = sorted(set(at["at"] or [0]))
    cuts = min(-(-at["n"] // (QUANTILES * BUCKET_ROWS)) or 1, QUANTILES)
    # Quantiles reach into each other where their keys are equal; equal keys share a place and a bucket.
    place = F.greatest(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))), F.lit(1)).alias("place")
    ids = keyed.select("key", place)
    inner = F.broadcast(ids.groupBy("place").agg(F.array_distinct(F.percentile_approx("key", [i / cuts for i in range(cuts)], 2000)).alias("inner")))

    def dealt(df: DataFrame) -> DataFrame:
        cut = F.greatest(F.size(F.filter("inner", lambda b: b <= F.col("key"))), F.lit(1))
        return df.join(inner, "place").withColumn("bucket", F.col("place").cast("long") * (QUANTILES + 1) + cut)

    # Of each bucket its highest id, and the bucket above it: within its place, else the lowest one of the next place; above all is the lowest.
    tops = dealt(ids).groupBy("place", "bucket").agg(F.max("key").alias("top"))
    lowest = tops.groupBy("place").agg(F.min("bucket").alias("lowest"))  # QUANTILES rows at most
    above = F.coalesce(F.lag("lowest").over(Window.orderBy(F.desc("place"))), F.min("lowest").over(Window.partitionBy()))
    tops = tops.withColumn("next_up", F.lag("bucket").over(Window.partitionBy("place").orderBy(F.desc("bucket"))))
    tops = tops.join(F.broadcast(lowest.select("place", above.alias("above"))), "place").select("bucket", "top", F.coalesce("next_up", "above").alias("before"))
    rows = dealt(keyed.select("row", "key", place)).join(F.broadcast(tops), "bucket")  # a row for each bucket
    copies = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")), F.when(F.col("key") == F.col("top"), F.struct(F.col("before").alias("b"), F.lit(1).alias("ghost")))))
    spread = rows.select("row", "key", F.explode(copies).alias("copy"))
    text = F.col("row")[text_col]
    window = Window.partitionBy("copy.b").orderBy("copy.ghost", F.desc("key"), F.xxhash64(text))
    return spread.withColumn("next", F.lead(text).over(window)).where(F.col("copy.ghost") == 0).select("row.*", F.col("next").alias(next_col))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of each row of documents (doc_id, text).

    The edited text is the text with its last third replaced by the beginning of the next one's,
    by descending id. Null texts count as empty; a single row is followed by itself; rows with
    null or repeated ids are rows like others (see with_next for their order). Other columns are
    not looked at.
    """
    docs = with_next(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")
    n = F.length("text")
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 3) AS int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) AS int))")).alias("edited"))
    trees = docs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("new"), fingerprint(F.col("next_text")).alias("next"))
    out = trees.select("doc_id", "n_chars", "edited_sha256", encoded(F.col("own")).alias("fingerprint"), encoded(F.col("new")).alias("edited_fingerprint"), sentences(F.col("own")).alias("own"), sentences(F.col("new")).alias("new"), sentences(F.col("next")).alias("next"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nx FROM d),
e AS (SELECT *, substr(t, 1, n - n // 3) || substr(nx, 1, n // 3) AS ed FROM o),
u AS (SELECT doc_id, 'own' AS k, t FROM e UNION ALL SELECT doc_id, 'new', ed FROM e UNION ALL SELECT doc_id, 'next', nx FROM e),
p AS (SELECT doc_id, k, list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {'h': sha256(p), 's': list_transform(regexp_extract_all(p, '(?s).{1,24}?(?:[.!?]+[ \t\n\f\r]*|\z)|.{24}'), lambda x: substr(md5(x), 1, 8))})) AS ps FROM u),
s AS (SELECT doc_id, k, list_transform(ps, lambda x: {'h': sha256(array_to_string(list_transform(x, lambda p: p.h), '')), 'p': x}) AS ss FROM p),
f AS (SELECT doc_id, k, sha256(array_to_string(list_transform(ss, lambda x: x.h), '')) || '=' || array_to_string(list_transform(ss, lambda x: substr(x.h, 1, 16) || '{' || array_to_string(list_transform(x.p, lambda p: substr(p.h, 1, 16) || '(' || array_to_string(p.s, '') || ')'), '') || '}'), '') AS f,
  list_distinct(flatten(list_transform(ss, lambda x: flatten(list_transform(x.p, lambda p: p.s))))) AS w FROM s),
g AS (SELECT doc_id, any_value(f) FILTER (WHERE k = 'own') AS fingerprint, any_value(f) FILTER (WHERE k = 'new') AS edited_fingerprint, any_value(w) FILTER (WHERE k = 'own') AS own, any_value(w) FILTER (WHERE k = 'new') AS new, any_value(w) FILTER (WHERE k = 'next') AS nxt FROM f GROUP BY doc_id)
SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, fingerprint, edited_fingerprint,
CASE WHEN len(own) + len(new) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(own, new)) / (len(own) + len(new)) END AS near_edited,
CASE WHEN len(own) + len(nxt) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(own, nxt)) / (len(own) + len(nxt)) END AS near_next
FROM e JOIN g ON g.doc_id = e.doc_id
"""
