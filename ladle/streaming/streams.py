"""The incremental forms: event streams into facts, ratings, windows and per-user state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ladle.sources.scratch import discard, scratch_path, written

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
SIGNALS = "user_id long, ts timestamp, event_id long, key string, boost boolean, signal double"
AFFINITY = "user string, key string, affinity double, confidence double, n long"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """New event files of a folder as a stream, with ts as a timestamp."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is, through the stream into a Parquet table, which is returned.

    Append mode writes by Spark's file sink. In the other modes each batch has a folder of its
    own, named by its number, which a replay overwrites; complete gives the last one, update all.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    last = []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last.append(number)

    writer.foreachBatch(step).start().awaitTermination()
    if mode == "complete" and last:
        return spark.read.schema(stream.schema).parquet(f"{base}/out/batch={last[-1]}")
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def ingest(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


STARS = [f"rating_{k}" for k in range(1, 6)]
RATINGS = ", ".join(["recipe_id long", "total_ratings long", "stars long", *(f"{c} long" for c in STARS)])


def latest(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """A table that is kept by versions of buckets (path/batch=n/bucket=b): of each bucket the last version, of batches before that number if given."""
    every = spark.read.schema(f"{schema}, batch int, bucket int").parquet(path)
    if before is not None:
        every = every.where(F.col("batch") < before)
    last = every.select("bucket", "batch").groupBy("bucket").agg(F.max("batch").alias("batch"))
    return every.join(last, ["bucket", "batch"])


def running_ratings(rated: DataFrame, buckets: int = 64) -> tuple[DataFrame, str]:
    """Counts, stars and their sum per recipe of a stream (recipe_id, rating 1 to 5), after all there is, and where they are kept.

    A batch reads and writes the buckets (ranges of the recipes' hashes) that its ratings touch,
    and no others: it writes new versions of them in a folder named by its number, made of
    versions of former batches. A batch that is replayed overwrites that folder by the same.
    """
    spark = rated.sparkSession
    base = scratch_path(spark, "ratings")

    def step(batch: DataFrame, number: int) -> None:
        add_ratings(batch, number, f"{base}/out", buckets)

    rated.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(step).start().awaitTermination()
    return latest(spark, f"{base}/out", RATINGS).drop("batch", "bucket"), f"{base}/out"


def add_ratings(batch: DataFrame, number: int, path: str, buckets: int) -> None:
    """One batch of running_ratings; ratings outside 1 to 5 and null recipes don't count."""
    spark = batch.sparkSession
    counts = [F.count_if(F.col("rating") == k).alias(c) for k, c in enumerate(STARS, 1)]
    new = batch.where("rating BETWEEN 1 AND 5 AND recipe_id IS NOT NULL").groupBy("recipe_id").agg(F.count("*").alias("total_ratings"), F.sum("rating").cast("long").alias("stars"), *counts)
    new = new.withColumn("bucket", F.pmod(F.xxhash64("recipe_id"), F.lit(buckets)).cast("int"))
    if number:
        touched = new.select("bucket").distinct()
        new = new.unionByName(latest(spark, path, RATINGS, number).drop("batch").join(F.broadcast(touched), "bucket", "left_semi"))  # so many buckets at most
    total = new.groupBy("bucket", "recipe_id").agg(*(F.sum(c).alias(c) for c in ("total_ratings", "stars", *STARS)))
    total.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")


def trending(events: DataFrame, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def health(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and success rate per tumbling window."""
    ok = F.count_if(F.col("event_type") != "error")
    return events.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count("*").alias("total"), ok.alias("ok")).select(F.col("window.start").alias("start"), "total", "ok", F.round(F.col("ok") * 100.0 / F.col("total"), 2).alias("rate"))


def refine_triggers(events: DataFrame, every: int = 10) -> DataFrame:
    """(user_id, n) at every n-th event of a user; the count is kept in state."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for frame in frames:
            new = n + len(frame)
            out += [(key[0], m) for m in range((n // every + 1) * every, new + 1, every)]
            n = new
        state.update((n,))
        yield pd.DataFrame(out, columns=["user_id", "n"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long", "n long", "append", "NoTimeout")


def recipe_signals(events: DataFrame, tags: DataFrame, dwell: float = 3.0) -> DataFrame:
    """What each event says: (user_id, ts, event_id, key, boost, signal); events: user_id, ts, event_id, recipe_id, cooked, again, dwell; tags: recipe_id, dimension, tag_value, tag_id.

    A recipe that was cooked gives 0.4, 0.3 more if it would be made again, 0.2 less if not; a
    dwell of so many seconds gives 0.05, all else nothing. The key is the tag's dimension, but
    for cooked recipes' regions `region:` and the region. Of a recipe's tags of one dimension
    the last counts (of equal ids the largest value). Events may be a stream or a table.
    """
    again = F.when(F.col("again"), 0.3).when(~F.col("again"), -0.2).otherwise(0.0)
    told = events.withColumn("signal", F.when(F.col("cooked"), 0.4 + again).when(F.col("dwell") >= dwell, 0.05)).where("signal IS NOT NULL")
    last = F.max_by("tag_value", F.struct("tag_id", "tag_value")).alias("value")
    if events.isStreaming:
        last = tags.groupBy("recipe_id", "dimension").agg(last)
    else:
        # Tables, so that their sizes are known; tags of recipes that no event names are dropped before rows are grouped.
        named = written(told.select("recipe_id").distinct())
        last = written(tags.join(named, "recipe_id", "left_semi").groupBy("recipe_id", "dimension").agg(last))
        discard(named)
    key = F.when(F.col("cooked") & (F.col("dimension") == "region"), F.concat_ws(":", "dimension", "value")).otherwise(F.col("dimension"))
    return told.join(last, "recipe_id").select("user_id", "ts", "event_id", key.alias("key"), F.col("cooked").alias("boost"), "signal")


def signals_by_batch(events: DataFrame, tags: DataFrame) -> DataFrame:
    """recipe_signals of all there is in a stream of events, as a stream of the files that they are kept in.

    A stream's own plan would group the tags of all recipes in every batch; here a batch looks
    up those that its events name. Each batch has a folder of its own, named by its number,
    which a replay overwrites; it ends before the files are read.
    """
    spark = events.sparkSession
    base = scratch_path(spark, "signals")

    def step(batch: DataFrame, number: int) -> None:
        path = f"{base}/events/{number}"
        batch.write.mode("overwrite").parquet(path)
        # Read back outside the stream's session, in which Spark doesn't adapt plans to sizes.
        told = spark.read.schema(batch.schema).parquet(path)
        recipe_signals(told, tags).write.mode("overwrite").parquet(f"{base}/out/{number}")
        discard(told)

    events.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(step).start().awaitTermination()
    return spark.readStream.schema(SIGNALS).parquet(f"{base}/out/*")


class Affinities(StatefulProcessor):
    """Per shard of users a map from user to what is known: by key affinity, confidence, number of signals and when it was written."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.known = handle.getMapState("affinities", "user_id long", "known map<string, struct<affinity: double, confidence: double, n: long, written: long>>", self.idle_ms)

    def recall(self, user: int | None, now: int) -> dict:
        """What is known of a user, but for keys that were not written for too long."""
        if not self.known.containsKey((user,)):
            return {}
        return {name: tuple(old) for name, old in self.known.getValue((user,))[0].items() if self.idle_ms is None or old[3] + self.idle_ms > now}

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        now = 0 if self.idle_ms is None else timer_values.getCurrentProcessingTimeInMs()
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        known, out = {}, {}
        for user, name, boost, signal in zip(events["user"], events["key"], events["boost"], events["signal"]):
            if user not in known:
                known[user] = self.recall(None if user is None else int(user), now)
            region = name.startswith("region:")
            old = known[user].get(name)
            if old:
                affinity, confidence, n, _ = old
                most = 0.95 if region else 0.85
                new = (min(affinity + signal, 1.0), min(confidence + 0.05, most) if boost else confidence, n + 1, now)
            elif region:
                new = (min(0.5 + signal, 1.0), 0.65, 1, now)
            else:
                new = (min(0.5 + signal, 1.0), 0.5 if boost else 0.3, 1, now)
            known[user][name] = out[user, name] = new
        for user, value in known.items():
            self.known.updateValue((None if user is None else int(user),), (value,))
        yield pd.DataFrame([(user, name, *value[:3]) for (user, name), value in out.items()], columns=["user", "key", "affinity", "confidence", "n"])

    def close(self) -> None:
        pass


def affinity_state(signals: DataFrame, idle: int | None = None, shard: int = 16) -> DataFrame:
    """Affinity per user and key after each batch, of a stream of recipe_signals; the state goes once it wasn't written for `idle` days.

    Affinity begins at 0.5, adds up the signals and stays within 1. Confidence: of regions
    cooked 0.6, and 0.05 for each time up to 0.95; of dimensions 0.5 if the first signal was a
    cooked recipe, else 0.3, and 0.05 for each cooked recipe that follows, up to 0.85. Within a
    batch signals count by time. The state is in RocksDB, which this sets for the session. idle
    is for streams that go on: a state that expires by the clock makes Spark run batch after
    batch, so that a trigger of all that is available doesn't end.

    A call of the Python code and a look into the state cost the same for one row as for many,
    so `shard` users with ids in a row share a call, and all keys of a user an entry. Ids go as
    text, as numbers with nulls among them would lose digits on the way.
    """
    signals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    user = F.col("user_id").cast("string").alias("user")
    together = F.coalesce(F.floor(F.col("user_id") / shard).cast("string"), F.lit("")).alias("shard")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    dealt = signals.select(together, user, at, "event_id", "key", "boost", "signal").groupBy("shard")
    states = dealt.transformWithStateInPandas(Affinities(None if idle is None else idle * 86_400_000), AFFINITY, "update", "None" if idle is None else "ProcessingTime")
    return states.select(F.col("user").cast("long").alias("user_id"), "key", "affinity", "confidence", "n")


TABLES = {"recipes": "recipe_id long, title string, tier string, total_time int", "ingredients": "recipe_id long, line int, original_text string, quantity double, unit string, item string", "steps": "recipe_id long, step int, instruction string, minutes int", "tags": "recipe_id long, dimension string, tag_value string", "similar": "a long, b long, score double"}
_TITLES = "t string, class_id long"
_RESTS = "t string, longer int, whole boolean, rest string"
_PIECES = "t string, n int, k int, at int, size int, piece string"


def incremental_recipes(spark: SparkSession, folder: str, files: int = 1000, least: float = 0.85, buckets: int = 16) -> dict[str, DataFrame]:
    """Recipes, ingredients, steps, dietary tags, similar titles and the quarantine of the pages that haven't been read yet, each file once; files: how many make a batch at most.

    A URL that a former batch had is skipped, and a page that failed is tried again as often as the
    quarantine allows, but no page of its URL with a larger id. Every batch has folders of its own, named by its number: a batch that is
    replayed overwrites what it wrote, and looks at former ones only.

    similar links classes of equal titles (a class is named by the first recipe that had its
    title), and each further recipe of a title with its class at 1. Former titles are looked up,
    not read: by the buckets of their hashes for equal ones, and for similar ones in indexes of
    rests (of short titles) and pieces (of longer ones), of which a batch reads the buckets that
    its own titles' rests and substrings fall into.
    """
    from ladle.functions.text import normalize_title
    from ladle.operators.extract import QUARANTINE, build_with_attempts, page_tags
    from ladle.operators.similarity import cut_pieces, longish, rest_keys, score_rests, score_strings, short_letters, similar_strings, substrings

    base = scratch_path(spark, "pages")
    short = short_letters(least)

    def former(table: str, schema: str, number: int) -> DataFrame:
        if not number:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, batch int").parquet(f"{base}/{table}").where(F.col("batch") < number).drop("batch")

    def save(df: DataFrame, table: str, number: int, by: str | None = None) -> DataFrame:
        path = f"{base}/{table}/batch={number}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def bucket(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")

    def similar(recipes: DataFrame, number: int) -> None:
        own = recipes.select("recipe_id", normalize_title(F.col("title")).alias("t")).where("t <> ''").withColumn("bucket", bucket("t"))
        known = former("titles", f"{_TITLES}, bucket int", number)
        had = own.join(known, ["bucket", "t"], "left").withColumn("class_id", F.coalesce("class_id", F.min("recipe_id").over(Window.partitionBy("t")))).join(known.select("bucket", "t", F.lit(True).alias("old")), ["bucket", "t"], "left")
        had = save(had.select("recipe_id", "t", "class_id", F.col("old").isNotNull().alias("old")), "own", number)
        new = save(had.where("NOT old").select("t", "class_id").distinct().withColumn("bucket", bucket("t")), "titles", number, "bucket").drop("bucket")
        rests = save(rest_keys(new.select("t"), least, short).withColumn("bucket", bucket("rest")), "rests", number, "bucket")
        pieces = save(cut_pieces(longish(new.select("t"), least, short), least).withColumn("bucket", bucket("piece")), "pieces", number, "bucket")
        inner = similar_strings(new.select("t"), least)
        sizes = former("sizes", "size int", number)
        asked = substrings(longish(new.select("t"), least, short).select(F.col("t").alias("u"), F.length("t").alias("m")), sizes.distinct()).withColumn("bucket", bucket("piece"))
        across = score_strings(former("pieces", f"{_PIECES}, bucket int", number), asked, least, on=["bucket", "piece"], short=short).union(score_rests(former("rests", f"{_RESTS}, bucket int", number), rests, least, ("bucket",)))
        save(pieces.select("size").distinct(), "sizes", number)
        classes = new.union(former("titles", f"{_TITLES}, bucket int", number).drop("bucket")) if number else new
        named = inner.union(across).join(classes.withColumnRenamed("class_id", "x"), "t").join(classes.select(F.col("t").alias("u"), F.col("class_id").alias("y")), "u")
        links = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
        equal = had.where("recipe_id <> class_id").select(F.least("recipe_id", "class_id").alias("a"), F.greatest("recipe_id", "class_id").alias("b"), F.lit(1.0).alias("score"))
        save(links.union(equal), "similar", number)

    def step(pages: DataFrame, number: int) -> None:
        before = spark.read.schema(QUARANTINE).parquet(f"{base}/quarantine/batch={number - 1}") if number else spark.createDataFrame([], QUARANTINE)
        built = build_with_attempts(pages, former("done", "url string", number), before)
        save(built["quarantine"], "quarantine", number)
        built["tags"] = page_tags(built["ingredients"])
        for name in ("recipes", "ingredients", "steps", "tags"):
            save(built[name], name, number)
        recipes = spark.read.schema(TABLES["recipes"]).parquet(f"{base}/recipes/batch={number}")
        save(pages.join(recipes.select(F.col("recipe_id").alias("page_id")), "page_id", "left_semi").select("url"), "done", number)
        similar(recipes, number)
        last[0] = number

    last = [-1]
    stream = spark.readStream.schema("page_id long, url string, html string").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(f"{folder}/pages.parque[t]")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(step).start().awaitTermination()
    out = {name: spark.read.schema(schema).parquet(f"{base}/{name}").select(*spark.createDataFrame([], schema).columns) for name, schema in TABLES.items()}
    return out | {"quarantine": spark.read.schema(QUARANTINE).parquet(f"{base}/quarantine/batch={last[0]}") if last[0] >= 0 else spark.createDataFrame([], QUARANTINE)}
