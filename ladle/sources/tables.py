"""Sources and sinks: scans, snapshots, upserts, deletes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: the trimmed, non-empty lines of text files."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "")


def read_sitemap(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """loc of each entry of sitemap files, or of a sitemap index."""
    return spark.read.format("xml").option("rowTag", "sitemap" if index else "url").schema("loc string").load(path).select(F.trim("loc").alias("loc")).where(F.col("loc").isNotNull())


def read_piped_records(spark: SparkSession, path: str) -> DataFrame:
    """name|id|count|ratio lines as typed rows; comment lines (#) and malformed ones are left out."""
    return spark.read.csv(path, sep="|", schema="name string, channel_id string, videos int, ratio double", mode="DROPMALFORMED", comment="#")


def insert_absent(existing: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """existing and those rows of seed whose key it doesn't have (get-or-create, dimension loads)."""
    return existing.unionByName(seed.dropDuplicates(key).join(existing.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert(current: DataFrame, updates: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: of all rows the one of the highest order, updates before current rows on ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def partial_update(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """current with the columns that updates has; a null there leaves the old value."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in changed))
    return current.join(new, key, "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in current.columns))


def append_fact(df: DataFrame, path: str, partition: str) -> None:
    df.write.mode("append").partitionBy(partition).parquet(path)


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than days before as_of."""
    return df.where(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def cascade_delete(ids: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each table without the rows that name a deleted id in one of its columns; ids: one column."""
    key = ids.columns[0]
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(ids.select(F.col(key).alias(c)), c, "left_anti").select(*df.columns)
        out[name] = df
    return out


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_url_list(urls: DataFrame, path: str) -> None:
    urls.select("url").distinct().orderBy("url").write.mode("overwrite").text(path)


def write_sitemap(urls: DataFrame, path: str, size: int = 20_000) -> None:
    """Distinct urls as sitemap files of about size entries (the format allows 50,000)."""
    files = urls.select("url").distinct().count() // size + 1
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    pages = urls.select("url").distinct().groupBy(F.pmod(F.xxhash64("url"), F.lit(files)).alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("entries"))
    pages.select("part", F.concat(F.lit("<urlset>"), "entries", F.lit("</urlset>")).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def mark(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """df with new values where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()})
