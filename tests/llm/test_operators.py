"""The operators against brute force, on small tables with nulls, empty, long and repeated rows and clashing columns."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ladle.llm import bpe, decontaminate, langid, licenses, merkle, neardup, quality, repeats, toxicity, urlfilter

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")


def words(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "One two"), (5, " \n\t ")]
    base = [words(rng, 60) for _ in range(6)]
    for i in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append((10 + i, " ".join(w)))
    out += [(100, base[0]), (101, base[0].upper()), (102, "é" * 40 + base[1][:80] + "漢字"), (103, "ab" * 3000), (104, words(rng, 4000, 30))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=width).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in sets.items()}


def test_near_duplicates_hidden_among_pages_of_a_template(spark):
    """Pages of a template are 0.78 alike and no duplicates; in each template two of 0.81 share nothing else."""
    rng = random.Random(11)
    rows, hidden = [], {}
    for site in range(4):
        shared = [f"t{site}x{k}" for k in range(200)]
        for page in range(100):
            i = 1000 * site + page
            own = 23 if page in (40, 70) else 28
            if own == 23:
                hidden[i] = 1000 * site + 40
            w = shared + [f"o{i}x{k}" for k in range(own)]
            rng.shuffle(w)
            rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, width=1).collect()}
    assert got == {i: hidden.get(i, i) for i, _ in rows}


def test_near_duplicates_few_links_in_a_crowd(spark):
    """Texts of one origin that are nearly all just below 0.8 alike: each of the few links must be found."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(800)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(800), rng.choice([23, 25, 27])):
            w[p] = f"x{i}y{p}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 2) for i, t in rows}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert 20 < len(pairs) < 2000
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=2).collect()}
    assert got == label and len(set(label.values())) > 10


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200))).astype(np.uint64) for _ in range(30)]
    got = neardup.common_counts(sets[:17], sets[17:], columns=64)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[17:]] for x in sets[:17]]


def test_slice_hashes():
    import numpy as np

    from ladle.llm.shared import slice_hashes

    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3500, 3000)
    end = start + rng.integers(0, 500, 3000)
    hashes, slices = slice_hashes(data, start, end), [data[a:b].tobytes() for a, b in zip(start, end)]
    by_hash = dict(zip(hashes.tolist(), slices))
    assert all(by_hash[h] == s for h, s in zip(hashes.tolist(), slices)) and len(by_hash) == len(set(slices))


def test_near_duplicates_bitmaps_drop_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 3000):
        x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: size - size // 6], rng.integers(0, 2**64, size // 8, dtype=np.uint64)]))
        bits = neardup.bitmaps([x, y])
        assert bits.shape == (2, neardup.LONGS)
        apart = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_near_duplicates_null_and_repeated_ids(spark):
    t = words(random.Random(1), 30)
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (9, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_sketches_lend_only_from_filled_bins():
    import numpy as np

    one = np.array([5], np.uint64)
    assert (neardup.sketches([one])[0] == 5).all()
    many = np.unique(np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    assert set(neardup.sketches([many])[0].tolist()) <= set(many.tolist())


def cut(rows, length=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen.setdefault(b[j : j + length], i) < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def test_repeats(docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in repeats.remove_repeats(docs).collect()}
    assert got == cut(rows)


def test_repeats_crowded(spark, monkeypatch):
    rng = random.Random(5)
    common = "a shared ending that many of these texts have, over fifty bytes of it"
    rows = [(i, words(rng, 12) + " " + common) for i in range(60)] + [(i, common * 2) for i in range(60, 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in repeats.remove_repeats(df).collect()}
    assert got == cut(rows)


def test_repeats_long(spark):
    """A context of many windows: its count needs more than a byte."""
    rng = random.Random(6)
    common = words(rng, 400, 5000)
    rows = [(i, f"{words(rng, 30, 5000)} {common} {words(rng, 30, 5000)}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (300, 600):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in repeats.remove_repeats(df, length=length).collect()}
        assert got == cut(rows, length)


def test_bpe_round_trip(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode(docs.withColumn("token_ids", F.lit(1)), RANKS)
    texts = dict(rows)
    for r in bpe.decode(coded, RANKS).collect():
        text = texts[r["doc_id"]] or ""
        assert r["token_ids"] == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert (r["token_ends"] or [0])[-1] == len(text.encode())


def test_bpe_in_one_worker(docs):
    want = {r["doc_id"]: (r["token_ids"], r["decoded"]) for r in bpe.decode(bpe.encode(docs.limit(20), RANKS), RANKS).collect()}
    both = bpe.encode_decode(docs.limit(20), RANKS)
    assert {r["doc_id"]: (r["token_ids"], r["decoded"]) for r in both.collect()} == want and "text" not in both.columns
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_bpe_boundaries():
    tiktoken = pytest.importorskip("tiktoken")
    import numpy as np

    lines = open(RANKS, "rb").read()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe._ranks(lines), special_tokens={})
    rng = random.Random(1)
    parts = ["'", "'s", "'re", "'ll", "l", "r", "e", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "…", " ", "漢", "😀", "s", "t", "'ve", "v", "́", "\x00", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["x" * 3000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    ids, _, begins = bpe.Encoder(lines).encode(offsets, np.frombuffer(b"".join(data), np.uint8))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [own.encode_ordinary(t) for t in texts]


def test_bpe_tells_slices_of_equal_hash_apart(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import numpy as np

    lines = open(RANKS, "rb").read()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe._ranks(lines), special_tokens={})
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    texts = [thue + " " + thue.translate(str.maketrans("ab", "ba")), "one two six ten", "", "two ten one six red"]

    def check(encoder):
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        ids, _, begins = encoder.encode(offsets, np.frombuffer(b"".join(data), np.uint8))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [own.encode_ordinary(t) for t in texts]

    check(bpe.Encoder(lines))
    monkeypatch.setattr(bpe, "slice_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    encoder = bpe.Encoder(lines)
    check(encoder)
    check(encoder)  # once more, out of the cache


def test_fingerprints(docs, rows):
    texts = sorted(rows, key=lambda r: -r[0])
    want = {}
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        t, n = t or "", n or ""
        k = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest())
    got = merkle.edited_fingerprints(docs).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert not re.search("Python|Pandas|Arrow", merkle.edited_fingerprints(docs)._jdf.queryExecution().toString())


def test_differing_paragraphs(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nB\n\nc\nd")], "a string, b string")
    got = df.select(merkle.differing_paragraphs(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("d")).first()["d"]
    assert [(x["section"], x["paragraph"]) for x in got] == [(0, 1), (1, 1)]


def test_segments_are_maximal():
    assert toxicity.segments([(2, 3.0), (3, 2.0), (10, 4.0)], 12, -0.5) == [(2, 11, 6.0)]
    assert toxicity.segments([(0, 1.0), (50, 1.0)], 60, -0.5) == [(0, 1, 1.0), (50, 51, 1.0)]


def best_segments(scores):
    """Maximal segments by their definition: the best one, and those on both sides of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2]):
                best = (a, b + 1, total)
    if best is None:
        return []
    left, right = best_segments(scores[: best[0]]), best_segments(scores[best[1] :])
    return [*left, best, *((a + best[1], b + best[1], s) for a, b, s in right)]


def test_segments_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.uniform(0.1, 3) if rng.random() < 0.5 else rng.choice([-0.5, -rng.uniform(0.1, 3)]) for _ in range(rng.randrange(25))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.5], len(scores), -0.5)
        want = best_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_segments_take_linear_time():
    import time

    began = time.time()
    assert len(toxicity.segments([(3 * i, 1.0) for i in range(300_000)], 900_000, -0.6)) == 300_000
    assert len(toxicity.segments([(i, 1.0 if i % 2 else -0.9) for i in range(300_000)], 300_000, -0.6)) == 1
    assert time.time() - began < 5


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 80) + (" zork blarg zork" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    more = df.union(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")).withColumn("score", F.lit("x"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scan(more, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)) and got[1000] < 0.5 and got[1001] < 0.5
    assert toxicity.fit(df, labels.where("toxic = 0")) is None


def test_language(spark, empty):
    rng = random.Random(4)
    stock = {"aa": ["kala", "mono", "rati", "pelo"], "bb": ["strumpf", "kreuz", "wald", "berg"]}
    rows = [(i, " ".join(rng.choice(stock[k]) for _ in range(20)), k) for i in range(60) for k in [["aa", "bb"][i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 40"))
    more = df.union(spark.createDataFrame([(90, None, None), (91, "12 ²³ !", None), (92, "kreuzwald", None)], df.schema))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(more, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and got[90] == ("und", 0.0) and got[91][0] == "und" and got[92][0] == "bb"
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, 60) if i % 3 else "JUNK!! " * 40) for i in range(300)]
    stats = quality.with_statistics(spark.createDataFrame([*rows, (998, None), (999, "")], "doc_id long, text string"))
    labelled = stats.join(spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int"), "doc_id")
    model = quality.fit(labelled, "quality")
    got = {r["doc_id"]: r["score"] for r in quality.with_score(stats, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300)) and 0 <= got[998] <= 1 and got[998] == got[999]
    assert quality.fit(labelled.where("false"), "quality") is None


def test_url_rules(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?y", "http://example.net/de/", "http://net", "https://x.org/fr/", "http://badnet/", "http://a.com/x.net/", "http://cheap-pills.com/", "http://example.com/de/a#b", "http://u:p@x.net:80/", "http://é.net/" + "a" * 3000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1))
    got = [(r["host"], r["path"][:20], r["rule"], r["verdict"]) for r in urlfilter.judge(df).orderBy("page_id").collect()]
    assert got[:11] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("net", "", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"),
        ("badnet", "/", None, "allow"), ("a.com", "/x.net/", None, "allow"), ("cheap-pills.com", "/", None, "block"), ("example.com", "/de/a", "example.com/de/", "block"), ("u:p@x.net:80", "/", None, "allow"),
    ]
    assert got[11][2:] == ("net/", "block")


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return row


def test_myers():
    rng = random.Random(0)
    for _ in range(300):
        p, t, k = "".join(rng.choices("ab", k=rng.randint(1, 12))), "".join(rng.choices("ab", k=rng.randint(0, 20))), rng.randint(0, 5)
        want = min(((v, j) for j, v in enumerate(distance(p, t)) if j and v <= k), default=None)
        assert decontaminate.Myers(p).search(t, k) == want


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 30, 500)) for i in range(5)] + [(8, None), (9, "!!")]
    rows = [(0, None), (1, ""), (2, words(rng, 200, 500))]
    for i in range(40):
        text = list(items[i % 5][1])
        for _ in range(rng.randrange(25)):
            at = rng.randrange(len(text))
            text[at] = rng.choice("qz ") if rng.random() < 0.6 else ""
        rows.append((10 + i, words(rng, 20) + "\n" + "".join(text).upper() + " " + words(rng, 20)))
    got = {r["doc_id"]: {m["item_id"]: m["distance"] for m in r["matches"]} for r in decontaminate.with_matches(spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        want = {}
        for k, x in items[:5]:
            x = decontaminate.normalised(x)
            best = min(distance(x, decontaminate.normalised(t or "")))
            if best <= len(x) // 10:
                want[k] = best
        assert got[i] == want


def test_short_items_match_whole_words(spark):
    rows = [(0, "It was yesterday."), (1, "Oh YES, that"), (2, "yes"), (3, "eyes")]
    got = decontaminate.with_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, "Yes!")], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["matches"]} == {1, 2}


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, words(rng, 20, 500)) for i in range(12)]
    rows = [(i, words(rng, 10) + " " + items[i][1] + " " + items[(i + 5) % 12][1]) for i in range(12)]
    df, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.with_matches(df, table).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    assert {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.with_matches(df, table).collect()} == whole
    assert all({i, (i + 5) % 12} == found for i, found in whole.items())
    # Null, empty and repeated rows, null ids and columns of any names are the same with one block and with many.
    odd = [(i, t, "x", i) for i, t in rows] + [(3, rows[3][1], "x", 3), (None, rows[4][1], "y", 1), (50, None, "z", 2), (51, "", "z", 2)]
    df = spark.createDataFrame(odd, ["number", "a `b`", "row", "found"])
    many = decontaminate.with_matches(df, table, text_col="a `b`")
    monkeypatch.undo()
    one = decontaminate.with_matches(df, table, text_col="a `b`")
    assert many.columns == one.columns == ["number", "a `b`", "row", "found", "matches"]
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))


def exact_licenses(text, templates, least=0.8):
    """All stretches of all templates by plain sets of word pairs."""
    w = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    pairs = list(zip(w, w[1:]))
    best = {}
    for name, template in templates:
        t = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", template.lower())
        want = set(zip(t, t[1:]))
        n = len(t) - 1
        for i in range(max(len(pairs) - n + 1, 1)):
            share = len(want & set(pairs[i : i + n])) / len(want)
            if share >= least:
                best[name] = max(best.get(name, 0), share)
    return best


def test_licenses_by_brute_force(spark):
    """Whole and edited templates of all lengths in longer texts; nearly all of what an exact scan finds must be found, and nothing else."""
    rng = random.Random(10)
    templates = [*licenses.TEMPLATES, ("two", "zork blarg"), ("long", words(rng, 700, 5000))]
    rows = []
    for i in range(200):
        t = templates[i % len(templates)][1].split()
        for _ in range(rng.randrange(1 + len(t) // 12)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
        w = words(rng, rng.randrange(400)).split()
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join([*w[:at], *t, *w[at:]])))
    got = {r["doc_id"]: {m["license"]: m["containment"] for m in r["licenses"]} for r in licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    want = {i: exact_licenses(t, templates) for i, t in rows}
    assert all(abs(want[i][k] - v) < 1e-12 for i, found in got.items() for k, v in found.items())
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, want.values())) and sum(map(len, want.values())) > 150


def test_licenses(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, "")]
    for i in range(60):
        w = words(rng, rng.randrange(100)).split()
        w.insert(rng.randrange(len(w) + 1), licenses.TEMPLATES[i % 11][1] if i % 2 else "licensed under")
        rows.append((10 + i, " ".join(w)))
    got = {r["doc_id"]: {m["license"] for m in r["licenses"]} for r in licenses.with_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ({licenses.TEMPLATES[(i - 10) % 11][0]} if i >= 10 and i % 2 else set()) for i, _ in rows}


def test_empty_tables(empty, spark):
    docs = empty.select("doc_id", "text")
    assert neardup.near_duplicates(docs).count() == 0
    assert repeats.remove_repeats(docs).count() == 0
    assert merkle.edited_fingerprints(docs).count() == 0
    assert bpe.digests(docs, RANKS).count() == 0
    assert licenses.with_licenses(docs).count() == 0
    assert quality.with_statistics(docs).count() == 0
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert decontaminate.with_matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None and toxicity.scan(docs, toxicity.Model({"a": 2.0})).count() == 0
    assert langid.predict(docs, langid.fit(empty)).count() == 0
    assert quality.with_score(quality.with_statistics(docs), None).count() == 0


CLASHES = ["row", "_row", "doc", "copy", "key", "bucket", "place", "inner", "found", "covered", "asked", "row_key", "matches_before", "_rest", "_key", "label", "id", "component", "hash"]


def test_clashing_columns(spark):
    """Columns with the names that operators use inside come through unchanged."""
    rng = random.Random(12)
    text = words(rng, 40)
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (None, "x")], "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHES})
    outs = [repeats.remove_repeats(docs), decontaminate.with_matches(docs, spark.createDataFrame([(1, text)], "item_id long, text string")), merkle.with_next(docs, "doc_id", "text"), licenses.with_licenses(docs), bpe.decode(bpe.encode(docs, RANKS), RANKS), langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit("aa")))), toxicity.scan(docs, toxicity.Model({"w1": 3.0})), quality.with_score(quality.with_statistics(docs), None), urlfilter.judge(docs, "text")]
    for out in outs:
        rows = out.collect()
        assert len(rows) == 4 and all(r[c] == c for r in rows for c in CLASHES), out.columns
    assert neardup.near_duplicates(docs).where("kept").count() == 3


def test_odd_names(spark):
    """Names with spaces, backticks and dots, of columns and of fields within them, come through unchanged."""
    text = words(random.Random(12), 40)
    odd = ["my col", "back`tick", "a.b", "x, y int"]
    inner = F.struct(F.lit(1).alias("a b"), F.array(F.struct(F.lit("z").alias("c`d"))).alias("e.f")).alias("nested")
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (None, "x")], "doc_id long, text string").select("doc_id", "text", inner, *(F.lit(c).alias(c) for c in odd))
    scored = quality.with_statistics(docs)
    fitted = quality.fit(quality.with_statistics(docs.withColumn("label", F.col("doc_id") % 2)), "label")
    outs = [repeats.remove_repeats(docs), licenses.with_licenses(docs), bpe.decode(bpe.encode(docs, RANKS, ids_col="my ids"), RANKS, ids_col="my ids", out_col="my`bytes"), langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit("aa")))), toxicity.scan(docs, toxicity.Model({"w1": 3.0}), score_col="my score"), quality.with_score(scored, None), quality.with_score(scored, fitted), urlfilter.judge(docs, "text")]
    for out in outs:
        rows = out.collect()
        assert len(rows) == 4, out.columns
        for r in rows:
            assert all(r[c] == c for c in odd) and r["nested"]["a b"] == 1 and r["nested"]["e.f"][0]["c`d"] == "z"


def test_ties_and_repeated_rows(spark):
    rng = random.Random(13)
    a, b = words(rng, 30), words(rng, 30)
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a), (2, a), (None, a), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["n_bytes"]) for r in repeats.remove_repeats(df).collect())
    assert got == sorted([(1, 0, len(a)), (1, 0, len(a)), (1, 0, len(b)), (2, len(a), len(a)), (2, len(a), len(a)), (0, 0, len(a)), (0, 0, 0)])
    assert merkle.edited_fingerprints(df).count() == 7
    nexts = sorted((r["doc_id"] or 0, r["text"] or "", r["next_text"] or "") for r in merkle.with_next(df, "doc_id", "text").collect())
    assert sorted(n for *_, n in nexts) == sorted(t for _, t, _ in nexts)  # every row follows one row
    assert licenses.with_licenses(df).count() == bpe.encode(df, RANKS).count() == 7


def test_next_text_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(merkle, "QUANTILES", 4)
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 5)
    ids = [*range(60), *range(10_000, 10_050), *(10**12 + k * k for k in range(40))]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, "doc_id", "text").collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"t{n}" for i, n in zip(down, down[1:] + down[:1])}


def test_very_long_texts(spark):
    """Texts of 2 MB: longer than the steps and tables that operators work in."""
    rng = random.Random(14)
    long = words(rng, 450_000, 30_000)
    rows = [(1, long), (2, "x" * 2_000_000), (3, long[:1_200_000] + " end"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for r in bpe.digests(df.where("doc_id <> 2"), RANKS).collect():
        assert r["decoded_sha256"] == hashlib.sha256(dict(rows)[r["doc_id"]].encode()).hexdigest()
    cut_rows = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(df).collect()}
    assert cut_rows[1] == cut_rows[2] == cut_rows[4] == 0 and 1_199_900 < cut_rows[3] <= 1_200_000
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, width=2).collect()}
    assert near[1][0] == len(shingles(long, 2)) and near[2] == (1, 2) and near[3][1] == 3
    merged = {r["doc_id"]: r["n_chars"] for r in merkle.edited_fingerprints(df).collect()}
    assert merged == {i: len(t) for i, t in rows}
    model = toxicity.Model({"w1": 4.0}, size=0.1)
    assert toxicity.scan(df, model).count() == quality.with_statistics(df).count() == licenses.with_licenses(df).count() == 4
    found = decontaminate.with_matches(df, spark.createDataFrame([(9, " ".join(long.split()[200_000:200_030]))], "item_id long, text string")).where("size(matches) > 0").collect()
    assert {r["doc_id"] for r in found} >= {1}
    assert langid.predict(df, langid.fit(df.withColumn("lang", F.lit("aa")))).where("lang_pred = 'aa'").count() == 3


def test_bounded_sample(spark):
    from ladle.llm.shared import bounded_sample

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 > 0).cast("int").alias("g"))
    kept = df.where(bounded_sample(df, "g", "doc_id", 300)).withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    for g, n in ((0, 200), (1, 300)):
        want = df.where(F.col("g") == g).orderBy(F.xxhash64(F.col("doc_id").cast("string"))).limit(n)
        assert kept.where(F.col("g") == g).select("doc_id").exceptAll(want.select("doc_id")).count() == 0 and kept.where(F.col("g") == g).count() == n


def test_a_sample_counts_ids_not_rows(spark):
    from ladle.llm.shared import bounded_sample

    rows = spark.createDataFrame([(i % 2000, "a" if i % 2000 < 1500 else "b") for i in range(20_000)], "doc_id long, lang string")
    got = rows.where(bounded_sample(rows, "lang", "doc_id", 400)).groupBy("lang").agg(F.count_distinct("doc_id").alias("ids"), F.count("*").alias("n")).collect()
    assert {(r["lang"], r["ids"], r["n"]) for r in got} == {("a", 400, 4000), ("b", 400, 4000)}


def test_many_rows_of_one_id_and_text(spark):
    rng = random.Random(6)
    text = words(rng, 120)
    rows = [(1, text)] + [(2, text + " end")] * 300 + [(3, "own words only")]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, len(text), 0, 0), (2, len(text) + 4, len(text), 1), (3, 14, 0, 0)}


def _random_texts(spark, n):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(n)]
    texts[n // 2 :: 7] = [t[:200] + u[200:] for t, u in zip(texts[::7], texts[n // 2 :: 7])]
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, copy int, text string").coalesce(1)


def test_what_repeats_send_hardly_grows_with_the_number_of_ranges(spark):
    texts = _random_texts(spark, 2000)

    def sent(count):
        return repeats._send_contexts(texts, 50, count).selectExpr("sum(octet_length(blob))").first()[0]

    assert sent(1000) < 1.35 * sent(10)


def test_repeats_that_are_sent_in_many_rounds(spark, monkeypatch):
    docs = _random_texts(spark, 300).select(F.col("doc").alias("doc_id"), "text")
    want = sorted(map(tuple, repeats.remove_repeats(docs).collect()))
    assert sum(r[4] for r in want) > 1000
    for name, number in (("GATHERED", 700), ("SENT", 1), ("RANGE", 90)):
        monkeypatch.setattr(repeats, name, number)
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == want
    # An id that stands twice: its rows are told apart by their texts.
    twice = docs.withColumn("doc_id", F.col("doc_id") - F.col("doc_id") % 2)
    got = {r["text"]: r["n_removed"] for r in repeats.remove_repeats(twice).collect()}
    assert all(got[r[1]] == r[4] for r in want if r[4])
