"""Quality classifier (operator 1): kernel ridge scores on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a text;
every partition sums its part of the normal equations; the ridge scores are calibrated by
isotonic regression (pooled adjacent violators over a fixed number of score bins) of scores that
each labelled row gets from the other folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, held_out, map_batches, quoted, slice_hashes, steps, table, text_bytes, words_of, written

STATS = ["log_bytes", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits", "spaces", "stops", "exclamations", "symbols", "beyond_ascii", "words_distinct", "words_repeated", "lines_distinct", "line_words", "line_end_stops"]
BINS = 2000
#: Parts of the labelled rows; each one is scored by a ridge of the others for the calibration. SUMMED: matrices that one task adds.
FOLDS, SUMMED = 4, 16


def _byte_kinds() -> np.ndarray:
    """Bits of each byte: 1 letter, 2 upper case, 4 digit, 8 white space, 16 sentence mark, 32 exclamation mark, 64 other ASCII mark, 128 beyond ASCII."""
    kinds = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = 1 * c.isalpha() | 2 * c.isupper() | 4 * c.isdigit() | 8 * (c in " \t\n\r\f\v")
        if not c.isalnum() and c not in " \t\n\r\f\v":
            kinds[b] |= 16 if c in ".,;:?'\"-" else 32 if c == "!" else 64
    kinds[128:] = 128
    return kinds


KINDS = _byte_kinds()


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of STATS for each text; an empty text has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(STATS)))
    size = np.diff(offsets)
    if not len(data):
        return out
    kinds = KINDS[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        return run[offsets[1:]] - run[offsets[:-1]]

    letters, upper, digits, spaces, stops, shouts, symbols, far = (per_text((kinds >> i) & 1).astype(float) for i in range(8))
    start, end, first = words_of(data, offsets)
    hashes = slice_hashes(data, start, end)
    length = (end - start).astype(float)
    count = np.diff(first).astype(float)

    def word_sums(values: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(values)])
        return run[first[1:]] - run[first[:-1]]

    least = np.maximum(count, 1)
    mean = word_sums(length) / least
    spread = np.sqrt(np.maximum(word_sums(length**2) / least - mean**2, 0))
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    same = np.concatenate([[False], (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])])
    distinct = count - np.bincount(owner[order][same], minlength=n)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])])
    ends = data == 10
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    begins[1:][ends] = True
    line_start = np.flatnonzero(begins[:-1])
    line_end = np.append(line_start[1:], len(data))
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    line_hash = slice_hashes(data, line_start, line_end)
    order = np.lexsort((line_hash, line_owner))
    same = np.concatenate([[False], (line_hash[order][1:] == line_hash[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])])
    lines = np.bincount(line_owner, minlength=n).astype(float)
    line_copies = np.bincount(line_owner[order][same], minlength=n)
    stop_words = word_sums((KINDS[data[end - 1]] & 16) > 0) if len(end) else np.zeros(n)
    some = np.maximum(size, 1).astype(float)
    out[:] = np.stack([np.log1p(size), np.log1p(count), mean, spread, letters / some, upper / np.maximum(letters, 1), digits / some, spaces / some, stops / some, shouts / some, symbols / some, far / some, distinct / least, np.bincount(owner[again], minlength=n) / least, 1 - line_copies / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1)), stop_words / least], 1)
    return out * (size > 0)[:, None]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text but with STATS (whole texts; null counts as empty; repeated rows stay).

    Columns of docs named like one of STATS are replaced, all others stay.
    """
    names = docs.columns
    others = [c for c in names if c != text_col and c not in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(names.index(text_col)))
            for a, b in steps(offsets):
                rows = statistics(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in others), *(pa.array(rows[:, j]) for j in range(len(STATS)))], names=[*others, *STATS])

    return map_batches(docs, run, others, ", ".join(f"{s} double" for s in STATS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.centres, self.levels), 0, 1)


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on sorted x: centres and rising levels of the pooled blocks."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS], 1)


def solved(total: np.ndarray, n: float, ridge: float) -> np.ndarray:
    """Ridge weights from the sums of products of features and label (the last row and column)."""
    side = len(total) - 1
    return np.linalg.solve(total[:-1, :-1] + ridge * max(n, 1) / (side - 1) * np.eye(side), total[:-1, -1])


def fit(labelled: DataFrame, label_col: str, waves: int = 256, width: float = 3.0, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """A model of label_col (0 to 1) on rows that have STATS; None without labelled rows.

    All labelled rows count. Each partition sends a matrix of (waves + 2)^2 numbers for each
    fold; tasks add SUMMED of them, round by round, until SUMMED a fold reach the driver at most.
    labelled is read three times: write it first where it is dear.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).select(*STATS, F.col(label_col).cast("double").alias("label"), F.pmod(F.xxhash64(*STATS), F.lit(FOLDS)).cast("int").alias("fold"))
    head = rows.agg(F.count("*").alias("n"), *(F.avg(s).alias(f"m_{s}") for s in STATS), *(F.stddev_pop(s).alias(f"d_{s}") for s in STATS)).first()
    if not head["n"]:
        return None
    random = np.random.default_rng(seed)
    mean, spread = np.array([head[f"m_{s}"] for s in STATS]), np.array([head[f"d_{s}"] for s in STATS])
    model = Model(mean, np.maximum(spread, 1e-6), random.normal(0, 1 / width, (len(STATS), waves)), random.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.zeros(1), np.zeros(1))
    side = waves + 2
    schema = "part long, fold int, total binary"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                yield model.features(_matrix(part)), *(part.column(len(STATS) + i).to_numpy() for i in (0, 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((FOLDS, side, side))
        for z, label, fold in chunks(batches):
            z = np.concatenate([z, label[:, None]], 1)
            for k in range(FOLDS):
                own = z[fold == k]
                total[k] += own.T @ own
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * FOLDS, pa.int64()), pa.array(range(FOLDS), pa.int32()), pa.array([t.tobytes() for t in total])], names=["part", "fold", "total"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in parts["total"])
        return pd.DataFrame({"part": parts["part"].iloc[:1] // SUMMED, "fold": parts["fold"].iloc[:1], "total": [total.tobytes()]})

    parts = written(rows.mapInArrow(sums, schema))
    while parts.agg(F.max("part")).first()[0] >= SUMMED:
        fewer = written(parts.groupBy("fold", F.floor(F.col("part") / SUMMED)).applyInPandas(add, schema))
        discard(parts)
        parts = fewer
    total = np.zeros((FOLDS, side, side))
    for r in parts.select("fold", "total").collect():
        total[r["fold"]] += np.frombuffer(r["total"]).reshape(side, side)
    discard(parts)
    whole = total.sum(0)
    # The last feature is 1, so its square counts the rows.
    others = np.stack([solved(whole - t, (whole - t)[-2, -2], ridge) for t in total], 1)
    model.weights = solved(whole, head["n"], ridge)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for z, label, fold in chunks(batches):
            raw = (z @ others)[np.arange(len(z)), fold]
            yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(label)], names=["raw", "label"])

    bins = F.round(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), F.col("raw"))) * (BINS // 2)).cast("int")
    at = rows.mapInArrow(scores, "raw double, label double").groupBy(bins.alias("bin")).agg(F.avg("label").alias("y"), F.count("*").alias("n"), F.avg("raw").alias("x")).orderBy("bin").collect()  # BINS rows at most
    model.centres, model.levels = pooled(*(np.array([r[c] for r in at], float) for c in ("x", "y", "n")))
    return model


def with_score(rows: DataFrame, model: Model | None, score_col: str = "score") -> DataFrame:
    """rows (with STATS) without STATS but with a score; 0.5 without a model.

    Repeated rows stay. A column named score_col is replaced, all others stay.
    """
    names = rows.columns
    others = [c for c in names if c not in STATS and c != score_col]
    if model is None:
        return rows.select(*(F.col(quoted(c)) for c in others), F.lit(0.5).alias(score_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), 4096):
                part = batch.slice(a, 4096).rename_columns(names)
                values = model.score(_matrix(part)) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in others), pa.array(values)], names=[*others, score_col])

    return map_batches(rows, run, others, f"{quoted(score_col)} double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by labels of the four folds that aren't held out."""
    out = F.coalesce(held_out("doc_id", 5, 0), F.lit(False))
    stats = written(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & ~out).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    labelled = written(stats.join(labels, "doc_id").select(*STATS, "quality"))
    model = fit(labelled, "quality")
    discard(labelled)
    scored = with_score(stats.withColumn("held_out", out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
