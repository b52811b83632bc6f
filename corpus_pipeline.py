"""A training corpus from `documents`: five stages, each one operator of ladle.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in
the shared folder and reads it back for the next stage. All but the last return the columns of
their docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.llm import bpe, decontaminate, langid, neardup, repeats
from ladle.llm.shared import bounded_batches, table, written

#: A document whose language has a smaller share than this is rejected, as is one without letters.
LEAST_LANGUAGE_SHARE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """name, lengthened until docs has no column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that docs declare.

    Null and empty texts and such without a letter go, as does every row where docs declare no
    language; repeated rows stay.
    """
    bounded_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    lang, share = _free(docs, "predicted"), _free(docs, "share")
    found = langid.predict(docs, model, lang_col=lang, score_col=share)
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(share) >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    Null and empty texts and rows with a null id stay; rows that repeat an id stay or go together.
    """
    bounded_batches(spark)
    gone = neardup.near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that documents of smaller ids have; n_chars follows.

    A code point cut in two leaves U+FFFD. A text of which nothing is left stays as an empty one.
    Null texts and rows with a null id stay as they are; rows that repeat an id don't count
    against each other.
    """
    bounded_batches(spark)
    out = repeats.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept_bytes").cast("string"))).otherwise(F.col("text"))
    changed = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return changed.withColumn("text", text).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts and repeated rows stay."""
    bounded_batches(spark)
    matches = _free(docs, "matches")
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"), out_col=matches)
    return found.where(F.size(matches) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the bytes they decode to (null and empty texts: no ids)."""
    bounded_batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "n_chars", "text"), path)
    digests = {"n_tokens": F.size("token_ids").cast("long"), "ids_sha256": F.sha2(F.array_join("token_ids", " ").cast("binary"), 256), "decoded_sha256": F.sha2("decoded", 256)}
    return coded.withColumns(digests).drop("decoded")


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", repeated_passages), ("benchmark decontamination", benchmark_free), ("byte-level BPE", tokens)]
#: SQL can't express the language model, the edit distances or the tokens; tests/llm compares run() with a plain pipeline on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
