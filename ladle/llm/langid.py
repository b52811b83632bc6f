"""Language identification (operator 8): word-first backoff.

A known word scores by its log frequency in each language; a word not seen in training falls
back to its character 5-grams, and while none of those is known, to shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, frugal, held_out, map_batches, quoted, steps, table, text_bytes

UNDETERMINED = "und"
LONGEST = 5
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Log frequencies: one row of `scores` for each known word, then one for each of grams (sorted), one column a language.

    evidence: a text's words aren't independent, so together they say as much as this many do at
    most. This changes how sure a prediction is, not which one it is.
    """

    languages: list[str]
    words: dict[str, int]
    grams: np.ndarray
    scores: np.ndarray
    evidence: float = 40.0


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 2500) -> Model:
    """A model of the languages in labelled.

    At most max_docs documents of each language are learnt from (those of the smallest id
    hashes), which bounds what reaches the driver; all their words and n-grams count. Rows with
    null text or language are left out.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    chosen = bounded_sample(rows.select(id_col, lang_col), lang_col, id_col, max_docs)
    sample = rows.where(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "token", "c"])
            found.clear()
            return batch

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, c in Counter(_WORDS.findall(text.lower())).items():
                    found[lang, 0, word] += c
                    for n in range(1, LONGEST + 1):
                        for gram in _grams(word, n):
                            found[lang, n, gram] += c
                if len(found) > 400_000:
                    yield out()
        if found:
            yield out()

    counts = sample.mapInArrow(frugal(count), "lang string, n int, token string, c long").groupBy("lang", "n", "token").agg(F.sum("c").alias("c")).toArrow()
    languages = sorted(counts["lang"].unique().to_pylist())
    column = pa.compute.index_in(counts["lang"], pa.array(languages, pa.string())).to_numpy()
    n, c = counts["n"].to_numpy(), counts["c"].to_numpy()
    mass = np.zeros((LONGEST + 1, max(len(languages), 1)))
    np.add.at(mass, (n, column), c)

    def part(some: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Tokens, and a row of log frequencies for each."""
        token = counts["token"].filter(pa.array(some)).combine_chunks().dictionary_encode()
        if isinstance(token, pa.ChunkedArray):
            token = token.combine_chunks()
        code = token.indices.to_numpy()
        value, of = np.zeros((len(token.dictionary), mass.shape[1])), np.zeros(len(token.dictionary), int)
        value[code, column[some]], of[code] = c[some], n[some]
        return token.dictionary.to_pylist(), np.log((value + 0.5) / (mass[of] + 100.0))

    words, of_words = part(n == 0)
    grams, of_grams = part(n > 0)
    grams = np.array(grams, f"<U{LONGEST}")
    order = np.argsort(grams, kind="stable")
    return Model(languages, {t: i for i, t in enumerate(words)}, grams[order], np.concatenate([of_words, of_grams[order]]).astype(np.float32))


class Scorer:
    """Scores words by a model; keeps the rows of words met so far, at most CACHE of them."""

    CACHE = 60_000

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.rows = dict(self.model.words)
        self.more: list[np.ndarray] = []

    def _unseen(self, word: str) -> int:
        row = np.zeros(max(len(self.model.languages), 1), np.float32)
        if not any(map(str.isalpha, word)):
            self.rows[word] = -1
            return -1
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            grams = np.array(_grams(word, n))
            at = np.minimum(np.searchsorted(self.model.grams, grams), max(len(self.model.grams) - 1, 0))
            at = at[self.model.grams[at] == grams] if len(self.model.grams) else at[:0]
            if len(at):
                row = self.model.scores[len(self.model.words) + at].sum(0) / n
                break
        self.rows[word] = at = len(self.model.scores) + len(self.more)
        self.more.append(row)
        return at

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its share against the others (0 for UNDETERMINED)."""
        if len(self.rows) > len(self.model.words) + self.CACHE:
            self._clear()
        names = self.model.languages
        get, unseen = self.rows.get, self._unseen
        found = [[r for w in _WORDS.findall(t.lower()) if (r := (unseen(w) if (k := get(w)) is None else k)) >= 0] for t in texts]
        numbers = np.array([len(f) for f in found], np.int64)
        best, share = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not names or not numbers.any():
            return best, share
        matrix = np.concatenate([self.model.scores, np.array(self.more, np.float32).reshape(-1, len(names))])
        flat = np.fromiter((r for f in found for r in f), np.int64, int(numbers.sum()))
        some = np.flatnonzero(numbers)
        starts = (np.cumsum(numbers) - numbers)[some]
        total = np.add.reduceat(matrix[flat].astype(float), starts, axis=0)
        total *= np.minimum(1, self.model.evidence / numbers[some])[:, None]
        total -= total.max(1, keepdims=True)
        odds = np.exp(total)
        top = total.argmax(1)
        share[some] = odds[np.arange(len(some)), top] / odds.sum(1)
        for i, j in zip(some.tolist(), top.tolist()):
            best[i] = names[j]
        return best, share


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score from 0 to 1.

    Text that is null or has no letter gives `und` and 0; repeated rows stay. Columns of docs
    named like the new ones are replaced, all others stay. The model's size is bounded (see
    fit), so it goes to every task.
    """
    keep = docs.drop(lang_col, score_col)
    names = keep.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            column = batch.column(names.index(text_col))
            for a, b in steps(text_bytes(column)[0]):
                best, share = scorer.score([t or "" for t in column.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(best, pa.string()), pa.array(share)], names=[*names, lang_col, score_col])

    return map_batches(keep, run, names, f"{quoted(lang_col)} string, {quoted(score_col)} double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model of the two folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out("doc_id", 3, 1), F.lit(False))
    model = fit(docs.where(~out).select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", "text", out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
