"""The registered queries and the pipeline: against their SQL, or against plain restatements in Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ladle.llm import decontaminate, langid, licenses, quality, queries, toxicity
from test_operators import RANKS, P, cut, distance, exact_licenses, shingles, words

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(docs["doc_id"].tolist(), docs["text"].tolist()))


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(queries.oracle_sql()[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).select(*want.column_names).toArrow()

    def rows(table):
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r.values()]) for r in table.to_pylist())

    assert rows(got) == rows(want)


def test_op9(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op9_bpe"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op2(spark, texts):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = set()
    for item_id, item in zip(items["item_id"].tolist(), items["text"]):
        item = decontaminate.normalised(item)
        search = decontaminate.Myers(item).search
        for i, t in texts.items():
            hit = search(decontaminate.normalised(t or ""), len(item) // 10)
            if hit:
                want.add((i, item_id, hit[0]))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in QUERIES["op2_decontamination"](spark, SF).collect()} == want and want


def test_op6(spark, texts):
    got = {(r["doc_id"], r["license"]): r["containment"] for r in QUERIES["op6_licenses"](spark, SF).collect()}
    want = {(i, k): v for i, t in texts.items() for k, v in exact_licenses(t, licenses.TEMPLATES).items()}
    assert got == pytest.approx(want)


def plain_statistics(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality.STATS)
    bytes_ = [chr(b) for b in data]
    ascii_ = [c for c in bytes_ if ord(c) < 128]
    letters = sum(c.isalpha() for c in ascii_)
    white = " \t\n\r\f\v"
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", data) if x]
    size = [len(x) for x in w]
    lines = re.findall(rb"[^\n]*\n|[^\n]+", data)
    n, k = len(data), max(len(w), 1)
    stops, mean = ".,;:?'\"-", sum(size) / k
    return [
        math.log1p(n), math.log1p(len(w)), mean, math.sqrt(max(sum(s * s for s in size) / k - mean**2, 0)), letters / n, sum("A" <= c <= "Z" for c in ascii_) / max(letters, 1), sum(c.isdigit() for c in ascii_) / n,
        sum(c in white for c in ascii_) / n, sum(c in stops for c in ascii_) / n, bytes_.count("!") / n, sum(not c.isalnum() and c not in white + stops + "!" for c in ascii_) / n, sum(ord(c) > 127 for c in bytes_) / n,
        len(set(w)) / k, sum(a == b for a, b in zip(w, w[1:])) / k, len(set(lines)) / len(lines), math.log1p(len(w) / len(lines)), sum(chr(x[-1]) in stops for x in w) / k,
    ]


def test_statistics(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aB1 \n.!é%-") for _ in range(rng.randrange(200)))) for i in range(60)] + [(99, None), (100, "a b a b\n\nc c\n")]
    got = {r["doc_id"]: [r[s] for s in quality.STATS] for r in quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(plain_statistics(t)), (i, t)


def test_op1(spark, texts):
    """The whole fit once more with numpy alone: features, ridge, scores by other folds, pooled levels."""
    labels = pd.read_parquet(f"{SF}/labels.parquet").dropna(subset=["quality"])
    ids = sorted(texts)
    stats = np.array([plain_statistics(texts[i]) for i in ids])
    learnt = labels[[remainder(i, 5) != 0 for i in labels["doc_id"]]].groupby("doc_id")["quality"].mean()
    at = [ids.index(i) for i in learnt.index]
    x, y = stats[at], learnt.to_numpy(float)
    folds = spark.createDataFrame([tuple(map(float, r)) for r in x], [*quality.STATS]).select(F.pmod(F.xxhash64(*quality.STATS), F.lit(quality.FOLDS)).alias("f")).toPandas()["f"].to_numpy()
    got = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, SF).collect()}
    assert sorted(got) == ids and all(r["held_out"] == (remainder(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    rng = np.random.default_rng(7)
    directions, phases = rng.normal(0, 1 / 3, (17, 256)), rng.uniform(0, 2 * np.pi, 256)

    def features(s):
        z = np.clip((s - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
        return np.hstack([np.cos(z @ directions + phases) / np.sqrt(128), np.ones((len(z), 1))])

    def ridge(rows):
        f = features(x[rows])
        return np.linalg.solve(f.T @ f + 1e-3 * len(f) / 257 * np.eye(257), f.T @ y[rows])

    raw = np.array([features(x[i : i + 1])[0] @ ridge(folds != folds[i]) for i in range(len(x))])
    bins = np.floor(np.clip(raw, -0.5, 1.5) * 1000 + 0.5)
    points = [(raw[bins == b].mean(), y[bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    # Isotonic by its minimax formula.
    levels = [max(min(np.average([p[1] for p in points[a : b + 1]], weights=[p[2] for p in points[a : b + 1]]) for b in range(k, len(points))) for a in range(k + 1)) for k in range(len(points))]
    blocks = [[p for p, v in zip(points, levels) if v == pytest.approx(level)] for level in sorted({round(v, 12) for v in levels})]
    centres = [np.average([p[0] for p in b], weights=[p[2] for p in b]) for b in blocks]
    heights = [np.average([p[1] for p in b], weights=[p[2] for p in b]) for b in blocks]
    want = np.clip(np.interp(features(stats) @ ridge(np.ones(len(x), bool)), centres, heights), 0, 1)
    # The folds hang on the last bits of the statistics, which Spark and numpy may round apart, so a few rows may differ a little.
    assert np.mean(np.abs(want - [got[i]["score"] for i in ids]) < 1e-3) > 0.95


def test_op8(spark, texts):
    """Word-first backoff in plain dictionaries."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    counts = [Counter() for _ in range(6)]
    pattern = re.compile(r"[^\W\d_]+")
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    for i, lang, text in zip(docs["doc_id"], docs["lang"], docs["text"]):
        if lang is not None and text is not None and remainder(i, 3) != 1:
            for w in pattern.findall(text.lower()):
                counts[0][lang, w] += 1
                for n in range(1, 6):
                    counts[n].update((lang, g) for g in grams(w, n))
    languages = sorted({k for k, _ in counts[0]})
    mass = [Counter() for _ in range(6)]
    known = [set() for _ in range(6)]
    for n in range(6):
        for (lang, token), c in counts[n].items():
            mass[n][lang] += c
            known[n].add(token)

    def log(n, token):
        return np.array([math.log((counts[n][lang, token] + 0.5) / (mass[n][lang] + 100)) for lang in languages])

    def word(w):
        if w in known[0]:
            return log(0, w)
        for n in range(min(5, len(w) + 2), 0, -1):
            hits = [g for g in grams(w, n) if g in known[n]]
            if hits:
                return sum(log(n, g) for g in hits) / n
        return np.zeros(len(languages))

    got = {r["doc_id"]: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        found = [w for w in pattern.findall((text or "").lower()) if any(map(str.isalpha, w))]
        assert got[i]["held_out"] == (remainder(i, 3) == 1)
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = sum(map(word, found)) * min(1, 40 / len(found))
        share = np.exp(total - total.max())
        assert got[i]["lang_pred"] == languages[total.argmax()] and got[i]["score"] == pytest.approx(1 / share.sum(), abs=1e-4)
    assert langid.LONGEST == 5


def test_op10(spark):
    """Log-odds, the law of chance segments and the curve once more in plain Python."""
    folder = "/root/testdata/sf0.01"  # the smaller tables have too few toxic documents
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    texts = dict(zip(docs["doc_id"].tolist(), docs["text"].tolist()))
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    label = labels[[remainder(i, 5) != 0 for i in labels["doc_id"]]].dropna(subset=["toxic"]).groupby("doc_id")["toxic"].max().to_dict()

    def tokens(word):
        return [word, *(word[:n] + "*" for n in range(min(7, len(word) - 1), 2, -1))]

    split = {i: re.findall(r"\w+", (t or "").lower()) for i, t in texts.items()}
    seen = [Counter(), Counter()]
    for i, y in label.items():
        seen[y].update({x for w in split[i] for x in tokens(w)})
    n0, n1 = (sum(c.values()) for c in seen)
    weights = {}
    for x, t in seen[1].items():
        c = seen[0][x]
        a = 500 * (t + c) / (n0 + n1) + 0.5
        odds = math.log((t + a) / (n1 + 500 - t - a)) - math.log((c + a) / (n0 + 500 - c - a))
        if t >= 4 and odds / math.sqrt(1 / (t + a) + 1 / (c + a)) >= 3 and t > 2 * c * n1 / n0:
            weights[x] = odds
    scores = {i: [next((weights[x] for x in tokens(w) if x in weights), -0.05) for w in ws] for i, ws in split.items()}
    clean = [scores[i] for i, y in label.items() if not y]
    tops = Counter(round(s, 1) for ws in clean for s in ws if s > 0)
    total = sum(map(len, clean)) + 1
    shares = [(s, c / total) for s, c in tops.items()] + ([(max(weights.values()), 1 / total)] if weights else [])
    rest = 1 - sum(p for _, p in shares)
    low, high = 1e-3, 100.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if rest * math.exp(-0.05 * middle) + sum(p * math.exp(min(600, middle * s)) for s, p in shares) < 1 else (low, middle)
    decay = max(low, 0.05)

    def found(ws):
        return toxicity.segments([(k, s) for k, s in enumerate(ws) if s != -0.05], len(ws), -0.05)  # tested by itself

    best = [(len(ws), max((s for *_, s in found(ws)), default=0)) for ws in clean]
    size = (sum(s > 0 for _, s in best) + 1) / (sum(n * math.exp(-decay * s) for n, s in best) + 1)

    def surprise(ws):
        each = [size * len(ws) * math.exp(-decay * s) for *_, s in found(ws)]
        return sum(-math.log(e) for e in each if e <= 0.05)

    x = np.array([round(math.sqrt(surprise(scores[i])), 1) for i in label])
    y = np.array(list(label.values()), float)
    beta = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (y - p) - 1e-2 * beta)
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, folder).collect()}
    assert len(got) == len(texts) and weights
    for i, ws in scores.items():
        want = 1 / (1 + math.exp(-(max(beta[0], 0) * math.sqrt(surprise(ws)) + beta[1])))
        assert got[i]["held_out"] == (remainder(i, 5) == 0) and got[i]["score"] == pytest.approx(want, abs=1e-3) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


# --- the pipeline ----------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=20):
    """Documents with copies, near copies, shared passages, benchmark passages, nulls and texts without letters, and a benchmark."""
    rng = random.Random(seed)
    stock = {"aa": [f"ka{k}lo" for k in range(400)], "bb": [f"stru{k}mpf" for k in range(400)]}
    write = lambda k, n: " ".join(rng.choice(stock[k]) for _ in range(n))
    items = [(i, write("aa", 25)) for i in range(4)] + [(7, None)]
    shared = write("bb", 60)
    rows = [(0, None, "aa"), (1, "", "bb"), (2, "12 34 !", "aa"), (3, None, None)]
    for i in range(10, 70):
        k = ["aa", "bb"][i % 2]
        t = write(k, rng.randrange(30, 120))
        if i % 7 == 0:
            t += "\n" + shared
        if i % 9 == 0:
            t = t + " " + items[i % 4][1].replace("o", "", 3) + " " + write(k, 5)
        rows.append((i, t, k))
    for i in range(100, 110):
        w = rows[4 + (i % 20)][1].split()
        if i % 2:
            w[len(w) // 2] = "other"
        rows.append((i, " ".join(w), rows[4 + (i % 20)][2]))
    return [(i, t, k, "s", len(t) if t is not None else None) for i, t, k in rows], items


def save(spark, folder, rows, items):
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, items = corpus()
    save(spark, tmp_path, rows, items)
    # Language: texts with letters stay; the two languages share no word.
    left = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    sets = {r[0]: shingles(r[1], 5) for r in left}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    left = [r for r in left if label[r[0]] == r[0]]
    texts = {i: kept.decode("utf-8", "replace") for i, (*_, kept) in cut([r[:2] for r in left]).items()}
    asked = [decontaminate.normalised(t) for _, t in items if t]
    clean = {i: t for i, t in texts.items() if not any(min(distance(q, decontaminate.normalised(t))) <= len(q) // 10 for q in asked)}
    assert len(rows) > len(sets) > len(left) > len(clean) and any(texts[r[0]] != r[1] for r in left)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(clean)
    for i, t in clean.items():
        ids = own.encode_ordinary(t)
        assert (got[i]["n_chars"], got[i]["n_tokens"], got[i]["token_ids"], got[i]["decoded_sha256"]) == (len(t), len(ids), ids, hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("given", ["empty", "nulls", "repeated"])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, given):
    import corpus_pipeline

    text = words(random.Random(1), 80)
    rows = {"empty": [], "nulls": [(None, None, None, None, None), (1, None, "aa", None, None), (None, text, None, None, 5)], "repeated": [(1, text, "aa", "s", 9)] * 3 + [(2, text, "aa", "s", 9)] * 2}[given]
    save(spark, tmp_path, rows, [(1, "some passage of a benchmark")] if rows else [])
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(c) for c in ("row", "_lang", "_share", "_matches", "doc", "copy")})
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        counts.append(out.count())
    assert counts == {"empty": [0] * 5, "nulls": [0, 3, 3, 3, 3], "repeated": [5, 3, 5, 5, 5]}[given]
