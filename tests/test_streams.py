"""Streams in batches: replays change nothing, state goes on, failed pages are left alone, titles meet former ones."""

from ladle.operators import extract as X
from ladle.streaming import streams as St

PAGE = '<h1 class="title">{}</h1><ul class="ingredients"><li>2 cups garlic</li><li>1 cup rice</li></ul><ol class="method"><li>Cook it for 5 min</li><li>Serve the whole thing</li></ol>'


def test_ratings_by_versions_of_buckets(spark, tmp_path):
    path = f"{tmp_path}/ratings"
    batches = [[(1, 5), (1, 4), (2, 1), (None, 3), (3, 9)], [(1, 1), (7, 2)], [(2, 5)], []]

    def total():
        return {r["recipe_id"]: (r["total_ratings"], r["stars"], r["rating_1"], r["rating_5"]) for r in St.latest(spark, path, St.RATINGS).collect()}

    seen = []
    for number, rows in enumerate(batches):
        St.add_ratings(spark.createDataFrame(rows, "recipe_id long, rating int"), number, path, 16)
        seen.append(total())
    assert seen[-1] == {1: (3, 10, 1, 1), 2: (2, 6, 1, 1), 7: (1, 2, 0, 0)}
    # A batch that is replayed gives what it gave.
    St.add_ratings(spark.createDataFrame(batches[2], "recipe_id long, rating int"), 2, path, 16)
    assert total() == seen[-1]
    # The third batch holds one bucket only.
    third = spark.read.parquet(f"{path}/batch=2")
    assert {r["recipe_id"] for r in third.collect()} == {2} and third.select("bucket").distinct().count() == 1


def test_affinities_over_batches(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, key string, boost boolean, signal double"
    rows = [(1, "texture", False, 0.05), (1, "texture", True, 0.4), (1, "texture", True, 0.7), (1, "region:x", True, 0.2), (1, "region:x", True, 0.2), (2, "texture", True, 0.2), (2, "region", False, 0.05)]
    events = [(u, k, b, s) for _ in range(9) for u, k, b, s in rows]
    state = {}
    for u, key, boost, signal in events:
        a, c, n = state.get((u, key), (0.5, 0.6 if ":" in key else 0.25 if not boost else 0.45, 0))
        first = n == 0
        c = (0.65 if ":" in key else 0.5 if boost else 0.3) if first else min(c + 0.05, 0.95 if ":" in key else 0.85) if boost else c
        state[u, key] = (min(a + signal, 1.0), c, n + 1)
    data = [(u, i, key, boost, signal) for i, (u, key, boost, signal) in enumerate(events)]
    for part in range(3):
        some = spark.createDataFrame(data[part * 21 : part * 21 + 21], "user_id long, event_id long, key string, boost boolean, signal double")
        some.selectExpr("user_id", "timestamp_seconds(event_id) AS ts", "event_id", "key", "boost", "signal").coalesce(1).write.mode("append").parquet(f"{tmp_path}/signals")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/signals")
    got = St.run_once(St.affinity_state(stream), "affinity", "update").collect()
    last = {}
    for r in got:
        if r["n"] >= last.get((r["user_id"], r["key"]), (0, 0, 0))[2]:
            last[r["user_id"], r["key"]] = (r["affinity"], r["confidence"], r["n"])
    assert {k: tuple(round(x, 9) for x in v) for k, v in last.items()} == {k: tuple(round(x, 9) for x in v) for k, v in state.items()}
    assert len(got) > len(last)  # several batches


def test_signals_of_batches_look_up_the_recipes_that_they_name(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, recipe_id long, cooked boolean, again boolean, dwell double"
    tags = spark.createDataFrame([(r, d, f"{d}{r}{i}", i) for r in range(9) for d in ("texture", "region") for i in (2, 1)], "recipe_id long, dimension string, tag_value string, tag_id long")
    rows = [(1, 1, 3, True, True, 0.0), (1, 2, 4, False, None, 9.0), (2, 3, 5, False, None, 1.0), (None, 4, 3, True, False, 0.0), (2, 5, None, True, None, 0.0)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, recipe_id long, cooked boolean, again boolean, dwell double").selectExpr("user_id", "timestamp_seconds(event_id) AS ts", "event_id", "recipe_id", "cooked", "again", "dwell")
    static = St.recipe_signals(events, tags)
    # Only recipes of events that tell something were looked up.
    assert {r["recipe_id"] for r in spark.read.parquet(*static.inputFiles()).collect()} == {3, 4}
    for number in (1, 3, 5):
        events.where(f"event_id IN ({number}, {number - 1})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    got = St.run_once(St.signals_by_batch(stream, tags), "read").collect()
    want = [(1, 1, "region:region32", True, 0.7), (1, 1, "texture", True, 0.7), (1, 2, "region", False, 0.05), (1, 2, "texture", False, 0.05), (None, 4, "region:region32", True, 0.2), (None, 4, "texture", True, 0.2)]
    for found in (got, static.collect()):
        assert sorted(((r["user_id"], r["event_id"], r["key"], r["boost"], round(r["signal"], 9)) for r in found), key=lambda r: r[1:3]) == want


class CountedState(dict):
    """Stands for a map state; counts what is asked of it."""

    asked = 0

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self[key]

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_affinities_ask_the_state_a_few_times_a_user(spark):
    state = CountedState()
    affinities = St.Affinities(1000)
    affinities.known = state
    users, keys = ["-7", "9007199254740993", None], [f"region:{k}" for k in range(50)]

    def batch(keys, now):
        rows = [(u, i, i, k, True, 0.1) for i, k in enumerate(keys) for u in users]
        (out,) = affinities.handleInputRows(("0",), iter([St.pd.DataFrame(rows, columns=["user", "at", "event_id", "key", "boost", "signal"])]), Clock(now))
        return {(r.user, r.key): r.n for r in out.itertuples()}

    assert set(batch(keys, 0).values()) == {1}
    assert set(state) == {(-7,), (9007199254740993,), (None,)} and state.asked <= 3 * len(users)
    # A key that isn't written for the time given begins anew, as if it were gone; the others go on.
    assert set(batch(keys[:1], 900).values()) == {2}
    assert {k: n for (u, k), n in batch(keys[:2], 1100).items() if u == "-7"} == {"region:0": 3, "region:1": 1}
    assert state.asked <= 9 * len(users)


def test_affinities_of_odd_users(spark, tmp_path):
    ids = [2**53 + 1, -(2**53) - 1, 5, -1, None]
    rows = spark.createDataFrame([(u, n, "texture", False, 0.05) for n in range(3) for u in ids], "user_id long, event_id long, key string, boost boolean, signal double")
    rows.selectExpr("user_id", "timestamp_seconds(event_id) AS ts", "event_id", "key", "boost", "signal").coalesce(1).write.parquet(f"{tmp_path}/signals")
    got = St.run_once(St.affinity_state(spark.readStream.schema(St.SIGNALS).parquet(f"{tmp_path}/signals")), "affinity", "update").collect()
    assert {r["user_id"]: r["n"] for r in got} == dict.fromkeys(ids, 3) and len(got) == len(ids)


def test_a_page_that_fails_three_times_is_left_out(spark):
    bare = '<h2 class="heading">Bare dish</h2>'
    pages = spark.createDataFrame([(1, "http://a/1", PAGE.format("Plain rice dish")), (2, "http://a/2", bare), (3, "http://a/3", "nothing"), (4, "http://a/4", bare)], "page_id long, url string, html string")
    quarantine, done = spark.createDataFrame([], X.QUARANTINE), pages.where("false").select("url")
    seen = []
    for run in range(4):
        given = pages.withColumn("html", X.F.when(X.F.col("page_id") == 4, PAGE.format("Mended dish")).otherwise(X.F.col("html"))) if run == 2 else pages.where("page_id <> 4 OR html <> ''") if run < 2 else pages.where("page_id <> 4")
        out = X.build_with_attempts(given, done, quarantine)
        quarantine = spark.createDataFrame(out["quarantine"].collect(), X.QUARANTINE)
        seen.append(({r["page_id"] for r in out["rejects"].collect()}, {r["recipe_id"] for r in out["recipes"].collect()}, {r["url"][-1]: (r["attempts"], r["failed"]) for r in quarantine.collect()}))
    assert seen[0] == ({2, 3, 4}, {1}, {"2": (1, False), "3": (3, True), "4": (1, False)})
    assert seen[1] == ({2, 4}, {1}, {"2": (2, False), "3": (3, True), "4": (2, False)})
    assert seen[2] == ({2}, {1, 4}, {"2": (3, True), "3": (3, True)})
    assert seen[3] == (set(), {1}, {"2": (3, True), "3": (3, True)})


def test_titles_of_three_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches = [[(1, "Plain rice dish"), (2, "Plain rice dish!")], [(3, "plain rice dish"), (4, "Plain rice dishs"), (5, "Something else")], [(6, "Plain rice dishes"), (7, "something else")]]
    for rows in batches:
        spark.createDataFrame([(i, f"http://a/{i}", PAGE.format(x)) for i, x in rows], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")
    out = St.incremental_recipes(spark, folder, files=1)
    got = {(r["a"], r["b"]): round(r["score"], 3) for r in out["similar"].collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1.0, (1, 4): 0.938, (1, 6): 0.882, (4, 6): 0.941, (5, 7): 1.0}
    assert out["recipes"].count() == 7 and out["quarantine"].count() == 0


def test_the_text_of_a_page_is_read_once(spark):
    pages = spark.createDataFrame([(1, "http://a/1", PAGE.format("Plain rice dish")), (2, "http://a/1", PAGE.format("Other")), (3, "http://a/3", "nothing")], "page_id long, url string, html string")
    built = X.build_recipes(pages, pages.where("false").select("url"))
    assert all("html" not in built[name]._jdf.queryExecution().optimizedPlan().toString() for name in built)
    assert [r["recipe_id"] for r in built["recipes"].collect()] == [1] and [r["page_id"] for r in built["rejects"].collect()] == [3]


def test_of_equal_urls_the_smallest_id_counts_over_batches(spark, tmp_path):
    bare = '<h2 class="heading">Bare dish</h2>'
    folder = f"{tmp_path}/in"
    batches = [[(3, "http://a/1", bare), (4, "http://a/2", bare), (5, "http://a/3", bare)], [(6, "http://a/1", PAGE.format("Plain rice dish")), (2, "http://a/2", PAGE.format("Lentil soup")), (5, "http://a/3", PAGE.format("Mended dish"))]]
    for rows in batches:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")
    out = St.incremental_recipes(spark, folder, files=1)
    assert {r["recipe_id"] for r in out["recipes"].collect()} == {2, 5}
    assert [(r["page_id"], r["attempts"], r["failed"]) for r in out["quarantine"].collect()] == [(3, 1, False)]
