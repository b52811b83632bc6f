"""Toxicity (operator 10): significant passages by maximum-scoring segments.

Words get the log-odds of toxic against other documents under an informative Dirichlet prior; a
word too rare to have its own falls back to the longest of its beginnings that has. All other
words cost a little, so that random text has a negative mean. A linear scan finds all maximal
segments of a text; extreme-value statistics (as for local alignments) turn a segment's score
into the number of as good ones that chance would give in a text of that length, and a logistic
curve over the summed surprise gives the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, discard, held_out, map_batches, quoted, steps, table, text_bytes, written

_WORDS = re.compile(r"\w+")
#: Letters of the beginnings that are features beside the whole words, as n-grams of some lengths are elsewhere.
SHORTEST_STEM, LONGEST_STEM = 3, 7
PASSAGES = "array<struct<start:int,end:int,score:double,expected:double>>"


def _stems(word: str) -> list[str]:
    """The word's beginnings, longest first, marked as such."""
    return [word[:n] + "*" for n in range(min(LONGEST_STEM, len(word) - 1), SHORTEST_STEM - 1, -1)]


@dataclass
class Model:
    """weights: log-odds of words and, with a star, of beginnings. other: of all other words (below 0).

    decay and size: the parameters of the extreme-value law of chance segments, both fitted to clean documents.
    slope, level: of the logistic curve from surprise to score.
    """

    weights: dict[str, float]
    other: float = -0.05
    decay: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    level: float = 0.0

    def weight(self, word: str) -> float:
        own = self.weights.get(word)
        if own is None:
            own = next((w for s in _stems(word) if (w := self.weights.get(s)) is not None), self.other)
        return own


def segments(values: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, one past the last, score), in linear time.

    values: places and weights of the words that aren't worth `other`, in order; n: words.
    A candidate runs from one place to another; low and high are the cumulative sums at its
    ends. Each keeps a link to the nearest one before it that starts lower. A new one joins
    that one for as long as this raises its sum; links that were passed are never walked again.
    """
    starts: list[int] = []
    ends: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    links: list[int] = []
    total, at = 0.0, 0
    for place, value in values:
        total += (place - at) * other
        at = place + 1
        low, total = total, total + value
        if value <= 0:
            continue
        start, j = place, len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = links[j]
            if j < 0 or highs[j] >= total:
                break
            start, low, k = starts[j], lows[j], j
            j = links[j]
            del starts[k:], ends[k:], lows[k:], highs[k:], links[k:]
        starts.append(start)
        ends.append(at)
        lows.append(low)
        highs.append(total)
        links.append(j)
    return [(a, b, high - low) for a, b, low, high in zip(starts, ends, lows, highs)]


class Scanner:
    CACHE = 100_000

    def __init__(self, model: Model, most_expected: float = 0.05):
        self.model, self.most = model, most_expected
        self.known: dict[str, float] = {}

    def _values(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and weights of the words that have one of their own."""
        if len(self.known) > self.CACHE:
            self.known.clear()
        known, other = self.known, self.model.other
        values = []
        for i, word in enumerate(words):
            w = known.get(word)
            if w is None:
                w = known[word] = self.model.weight(word)
            if w != other:
                values.append((i, w))
        return values

    def best(self, text: str) -> tuple[int, float]:
        """The text's number of words, and the score of its best segment (0 without one)."""
        words = _WORDS.findall(text.lower())
        return len(words), max((s for *_, s in segments(self._values(words), len(words), self.model.other)), default=0.0)

    def scan(self, text: str) -> tuple[float, list[dict]]:
        """A text's surprise (-log of expected chance segments, summed) and its significant passages."""
        other = self.model.other
        words = _WORDS.findall(text.lower())
        values = self._values(words)
        if not values:
            return 0.0, []
        good = []
        for a, b, score in segments(values, len(words), other):
            rare = self.model.decay * score - math.log(max(self.model.size * len(words), 1e-300))  # -log of what chance gives
            if rare >= -math.log(self.most):
                good.append((a, b, score, rare))
        if not good:
            return 0.0, []
        places = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
        if len(places) != len(words):  # lower-casing changed the words' number
            places = [(0, len(text))] * len(words)
        passages = [{"start": places[a][0], "end": places[b - 1][1], "score": s, "expected": math.exp(-r)} for a, b, s, r in good]
        return sum(r for *_, r in good), passages


def _word_counts(sample: DataFrame) -> DataFrame:
    """Documents of each class that have a word or beginning: token, toxic, clean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(found[0].keys() | found[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[k][x] for x in keys], pa.int64()) for k in (1, 0))], names=["token", "toxic", "clean"])
            for f in found:
                f.clear()
            return batch

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORDS.findall((text or "").lower()))
                found[label].update(words)
                found[label].update({s for w in words for s in _stems(w)})
                if sum(map(len, found)) > 400_000:
                    yield out()
        if any(found):
            yield out()

    return sample.select("label", "text").mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 5000, least_docs: int = 4, least_z: float = 3.0, prior: float = 500.0) -> Model | None:
    """A model from labelled documents; None if a class is missing.

    At most max_docs documents of each class (those of the smallest id hashes) are learnt from,
    which bounds what reaches the driver; each class counts by its share of all labelled rows.
    Of these documents' words and beginnings all are kept that at least least_docs toxic ones
    have and whose log-odds lie least_z standard deviations above 0. prior: the weight of the
    Dirichlet prior in documents. A document labelled more than once counts as toxic if any
    label says so.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.where(bounded_sample(known.select(id_col, "label"), "label", id_col, max_docs))
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "label")), "id"))  # 2 * max_docs rows at most
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = written(_word_counts(sample))
    mass = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not mass["toxic"] or not mass["clean"]:
        return None
    n1, n0 = float(mass["toxic"]), float(mass["clean"])
    a = prior * (F.col("toxic") + F.col("clean")) / (n1 + n0) + 0.5
    odds = F.log((F.col("toxic") + a) / (n1 + prior - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (n0 + prior - F.col("clean") - a))
    z = odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    kept = counts.where(F.col("toxic") >= least_docs).select("token", odds.alias("odds"), z.alias("z"), "toxic", "clean").where((F.col("z") >= least_z) & (F.col("toxic") > 2 * F.col("clean") * n1 / n0))
    model = Model({r["token"]: r["odds"] for r in kept.select("token", "odds").collect()})
    clean = sample.where("label = 0").select("text")
    model.decay = _decay(model, clean)
    model.size = _size(model, clean)
    model.slope, model.level = _curve(model, sample, {k: sizes[k] / n for k, n in taken.items()})
    discard(sample, counts)
    return model


def _decay(model: Model, clean: DataFrame) -> float:
    """The root of E[exp(decay * weight)] = 1 over the words of clean documents."""
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        weight = shared.value.weight
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word, c in Counter(_WORDS.findall((text or "").lower())).items():
                    w = weight(word)
                    found[round(w, 1) if w > 0 else None] += c
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], names=["weight", "c"])

    rows = clean.mapInArrow(weigh, "weight double, c long").groupBy("weight").agg(F.sum("c").alias("c")).collect()  # weights are rounded: some hundred rows
    total = sum(r["c"] for r in rows) + 1.0
    tops = [(r["weight"], r["c"] / total) for r in rows if r["weight"] is not None]
    if model.weights:  # as if one more word of the clean documents had the highest weight: the law has a root then
        tops.append((max(model.weights.values()), 1 / total))
    rest = 1 - sum(p for _, p in tops)

    def excess(x: float) -> float:
        return rest * math.exp(x * model.other) + sum(p * math.exp(min(x * w, 600.0)) for w, p in tops) - 1

    low, high = 1e-3, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(low, 0.05)


def _size(model: Model, clean: DataFrame) -> float:
    """The likeliest size of the law P(best segment of n words < s) = exp(-size * n * exp(-decay * s)) of clean documents.

    A document without a segment only says that its best one lies below any score. One more
    document of one word, with the best score of all, keeps the size above 0.
    """
    shared = clean.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        seen, mass = 0, 0.0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, score = scanner.best(text or "")
                seen += score > 0
                mass += n * math.exp(-scanner.model.decay * score)
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([mass], pa.float64())], names=["seen", "mass"])

    row = clean.mapInArrow(best, "seen long, mass double").agg(F.sum("seen").alias("seen"), F.sum("mass").alias("mass")).first()
    return ((row["seen"] or 0) + 1) / ((row["mass"] or 0.0) + 1)


def _curve(model: Model, sample: DataFrame, weight: dict[int, float]) -> tuple[float, float]:
    """Slope and level of a logistic curve of the surprise's root, fitted in bins to the sample's labels; weight: rows that one row of a class stands for."""
    scored = scan(sample.select("label", "text"), model).select("label", F.round(F.sqrt("surprise"), 1).alias("x"))
    rows = scored.groupBy("x", "label").agg(F.count("*").alias("n")).collect()  # no more than the sample's rows
    x, y = (np.array([r[c] for r in rows], float) for c in ("x", "label"))
    n = np.array([r["n"] * weight[r["label"]] for r in rows])
    n *= sum(r["n"] for r in rows) / n.sum()
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (n * (y - p)) - 1e-2 * beta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    return max(float(beta[0]), 0.0), float(beta[1])


def scan(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs without its text but with surprise, score (0 to 1) and passages (offsets in characters).

    Null and empty texts have no passage; repeated rows stay. Columns of docs named like the new
    ones are replaced, all others stay. The model's size is bounded (see fit), so it goes to
    every task.
    """
    keep = docs.drop("surprise", score_col, "passages")
    names = keep.columns
    others = [c for c in names if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            column = batch.column(names.index(text_col))
            for a, b in steps(text_bytes(column)[0]):
                found = [scanner.scan(t or "") for t in column.slice(a, b - a).to_pylist()]
                surprise = np.array([s for s, _ in found])
                score = 1 / (1 + np.exp(-np.clip(scanner.model.slope * np.sqrt(surprise) + scanner.model.level, -30, 30)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in others), pa.array(surprise), pa.array(score), pa.array([p for _, p in found], kind)], names=[*others, "surprise", score_col, "passages"])

    return map_batches(keep, run, others, f"surprise double, {quoted(score_col)} double, passages {PASSAGES}")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by labels of the four folds that aren't held out."""
    out = F.coalesce(held_out("doc_id", 5, 0), F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~out))
    ready = docs.withColumn("held_out", out)
    if model is None:
        scored = ready.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("n_passages"))
    else:
        scored = scan(ready, model).select("doc_id", "held_out", "score", F.size("passages").alias("n_passages"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
