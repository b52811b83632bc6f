"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import datetime
import decimal
import math
import random

import duckdb
import pytest

from ladle import plans
from ladle.sources.fixtures import BASE

SF = "/root/testdata/sf0.001"
REGISTRY = plans.load()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY.queries()))
def test_query(spark, duck, name):
    df = REGISTRY.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = REGISTRY.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    named = [d[0] for d in found.description]
    assert sorted(named) == columns
    want = [tuple(plain(r[named.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def test_fuzz_ratio(spark, duck):
    want = {i: round(200 * lcs(a, b) / (len(a) + len(b))) for i, a, b in duck.execute("SELECT p_partkey, p_name, lower(concat(p_type, ' ', p_brand)) FROM part").fetchall()}
    assert {r["p_partkey"]: r["ratio"] for r in REGISTRY.queries()["fuzz_ratio"](spark, SF).collect()} == want


def test_fuzzy_lookup(spark, duck):
    """Every item against every name."""
    master = duck.execute("SELECT lower(p_name), min(p_partkey) FROM part GROUP BY 1").fetchall()
    synonyms = dict(duck.execute("SELECT lower(p_brand), min(p_partkey) FROM part GROUP BY 1").fetchall())
    got = REGISTRY.queries()["fuzzy_lookup_join"](spark, SF).collect()
    names = dict(master)
    assert {r["item"] for r in got} == {i for (i,) in duck.execute("SELECT DISTINCT concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END) FROM part").fetchall()}
    for r in got:
        item = r["item"].lower()
        exact = names.get(item) or synonyms.get(item)
        score, i = max((round(200 * lcs(item, n) / (len(item) + len(n))), -k) for n, k in master)
        assert r["ingredient_id"] == (exact if exact is not None else -i if score >= 70 else None)


@pytest.mark.parametrize("items, largest, number", [(14, 9, 120), (90, 60, 160)])
def test_similar_sets_by_brute_force(spark, items, largest, number):
    from ladle.operators.similarity import set_classes, similar_sets

    rng = random.Random(3)
    sets = {i: frozenset(rng.sample(range(items), rng.randrange(1, largest))) for i in range(number)}
    for i in range(number // 2, number):  # some differ in a few items only
        s = set(sets[rng.randrange(number // 2)]) ^ set(rng.sample(range(items), rng.randrange(4)))
        sets[i] = frozenset(s or {0})
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item long")
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    assert {r["id"]: r["class_id"] for r in set_classes(df).collect()} == {i: first[s] for i, s in sets.items()}
    for least in (0.5, 0.6, 0.7, 0.8, 0.95):
        want = {(i, j): len(s & u) / len(s | u) for s, i in first.items() for u, j in first.items() if i < j and len(s & u) >= least * len(s | u) - 1e-12}
        assert {(r["a"], r["b"]): pytest.approx(r["score"]) for r in similar_sets(df, least).collect()} == want


def test_pages_that_come_in_batches(spark, tmp_path):
    """New files make a second batch; what a former batch had is skipped, and its titles are compared with the new ones."""
    from ladle.streaming import streams

    page = '<h1 class="title">{}</h1><ul class="ingredients"><li>2 cups garlic</li><li>1 cup rice</li></ul><ol class="method"><li>Cook it for 5 min</li><li>Serve the whole thing</li></ol>'
    folder = f"{tmp_path}/pages.parquet"
    for pages in ([(1, "http://a/1", page.format("Plain rice dish")), (2, "http://a/2", "x")], [(3, "http://a/1", page.format("Again")), (4, "http://a/4", page.format("Plain rice dishs"))]):
        spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)
    out = streams.incremental_recipes(spark, str(tmp_path), files=1)
    assert {(r["recipe_id"], r["total_time"]) for r in out["recipes"].collect()} == {(1, 5), (4, 5)}
    assert [(r["page_id"], r["error"], r["attempts"], r["failed"]) for r in out["quarantine"].collect()] == [(2, "no title", 3, True)]
    assert {(r["a"], r["b"]) for r in out["similar"].collect()} == {(1, 4)}
    assert {(r["recipe_id"], r["dimension"], r["tag_value"]) for r in out["tags"].where("recipe_id = 4").collect()} == {(4, "health_allium_free", "false"), (4, "health_gluten_free", "true")}
    assert out["steps"].count() == 4 and out["ingredients"].count() == 4
