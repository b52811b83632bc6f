"""Phrase mining against brute force: many small shards, pieces, nulls, ties, repeated rows, clashing columns."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ladle.llm import phrases as P


def brute(rows, most_words, least):
    """(lang, phrase) -> (a, l, r, n, score, longest, left extensions, right extensions)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, most_words + 1):
                    if i + m <= len(w):
                        f[lang, w[i : i + m]] += 1
    out = {}
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for (lang, g), a in frequent.items():
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        holding = [(h, b) for (x, h), b in frequent.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        by_one = [h for h, _ in holding if len(h) == len(g) + 1]
        out[lang, " ".join(g)] = (a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score, not any(b >= a for _, b in holding), sum(h[1:] == g for h in by_one), sum(h[:-1] == g for h in by_one))
    return out


def found(df, **kwargs):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"], r["longest"], r["left_extensions"], r["right_extensions"]) for r in P.phrases(df, **kwargs).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(None, "en"), ("", "en"), ("...", None), ("one", None), ("\t \n", "de"), ("a" * 3000 + " b", "en"), ("é ü é ü, é ü", "fr")]
    for _ in range(150):
        words = [rng.choice(["a", "B", "c", "the", "The", "é", "x|y", "-"]) for _ in range(rng.randrange(60))]
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\r\n"]) for w in words), rng.choice(["en", "en", "de", None, "und"])))
    return out + [("same words here again, same words here", "en")] * 40


@pytest.mark.parametrize("most_words, least, size", [(5, 5, 300), (3, 20, 10**6), (2, 1, 50), (8, 3, 500)])
def test_phrases(spark, rows, most_words, least, size):
    df = spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows)], "text string, lang string, place long, word string, `a b` string").repartition(3)
    want = brute(rows, most_words, least)
    assert want and found(df, most_words=most_words, least=least, shard_words=size) == want


def test_no_rows_and_no_phrases(spark):
    assert found(spark.createDataFrame([], "text string, lang string")) == {}
    assert found(spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")) == {}


def test_counts_beyond_64_bits_in_products(spark):
    """1000 * a * n and l * r pass 64 bits from a few billion on; the expression is the one that phrases() uses."""
    a, n, left = 3_000_000_019, 9_000_000_000_037, 5_000_000_021
    got = spark.sql(f"SELECT CAST((CAST(1000 AS DECIMAL(38, 0)) * {a}L * {n}L) div (CAST({left}L AS DECIMAL(38, 0)) * {left}L) AS BIGINT) AS s").first()["s"]
    assert got == 1000 * a * n // (left * left)


def test_index_counts_every_short_phrase():
    rng = np.random.default_rng(1)
    text = np.append(np.append(0, rng.integers(0, 5, 400)), 0)
    forward, backward = P.transform(text, 4), P.transform(text[::-1], 4)
    assert (P.unpacked(P.packed(forward)) == forward).all()
    count = np.bincount(text)[1:]
    lo = other = (text == 0).sum() + np.cumsum(count) - count
    known, size = [(k + 1,) for k in range(len(count))], count
    for m in range(2, 5):
        of, begin, there, n = P.extended(backward, other, lo, size)
        of2, begin2, _, n2 = P.extended(forward, lo, other, size)
        want = Counter(tuple(text[i : i + m].tolist()) for i in range(len(text) - m + 1) if (text[i : i + m] > 0).all())
        assert sorted(zip((known[k] for k in of), n)) == sorted((g[:-1], c) for g, c in want.items())
        # Both ways give the same phrases with the same intervals.
        assert dict(zip(there.tolist(), n.tolist())) == dict(zip(begin2.tolist(), n2.tolist()))
        names = {}
        for g, c in want.items():
            names.setdefault((g[:-1], c), []).append(g)
        order = np.argsort(there)
        by_text = sorted(want)
        known = [by_text[k] for k in np.argsort(order)]
        assert [want[g] for g in known] == n.tolist()
        lo, other, size = there, begin, n


def test_ranks_over_many_partitions(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(50), i) for i in range(3000)]
    got = P.ranked(spark.createDataFrame(data, "g string, v long, i long").repartition(7), "g", [P.F.desc("v"), P.F.asc("i")], 700).collect()
    want = set()
    for g in "ab":
        want |= {(g, k, *x) for k, x in enumerate(sorted(((v, i) for h, v, i in data if h == g), key=lambda x: (-x[0], x[1]))[:700], 1)}
    assert {(r["g"], r["rank"], r["v"], r["i"]) for r in got} == want
