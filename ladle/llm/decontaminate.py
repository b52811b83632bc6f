"""Benchmark decontamination (operator 2): pigeonhole edit matching.

A test item may differ from a passage of a document by `budget` edits. Cut into budget + 1
pieces, one piece at least must stand in the passage unchanged. Exact hits of pieces are found
by one automaton over all items' pieces; each hit fixes where the item would lie, and Myers'
bit-parallel distance over that stretch verifies it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

_GAPS = re.compile(r"[\W_]+")
#: Items are matched in blocks of about so many characters, so that a task's automaton stays small however many items there are.
BLOCK_CHARS = 2_000_000
MATCHES = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normalised(text: str) -> str:
    """Lower case, with single spaces for all that isn't a letter or digit."""
    return _GAPS.sub(" ", text.lower()).strip()


def budget(size: int, percent: int) -> int:
    return size * percent // 100


def pieces(size: int, errors: int) -> list[int]:
    """Bounds of errors + 1 pieces of nearly equal size (none is empty: a budget is less than a size)."""
    return [size * i // (errors + 1) for i in range(errors + 2)]


class Myers:
    """Edit distance of a pattern to the best ending substring, a text character at a time, in one long bit string."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.mask = (1 << self.size) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the closest substring with at most `most` edits, the first of equals."""
        plus, minus, score, best = self.mask, 0, self.size, None
        top, mask, get = 1 << (self.size - 1), self.mask, self.masks.get
        for j, c in enumerate(text):
            equal = get(c, 0)
            diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
            up = minus | (~(diagonal | plus) & mask)
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & mask
            down = (down << 1) & mask
            plus = down | (~((equal | minus) | up) & mask)
            minus = up & (equal | minus)
            if score <= most and (best is None or score < best[0]):
                best = (score, j + 1)
        return best


def _apart(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands between spaces or ends."""
    return (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")


class Matcher:
    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.items = items
        self.errors = [budget(len(t), percent) for _, t in items]
        self.bounds = [pieces(len(t), e) for (_, t), e in zip(items, self.errors)]
        self.paths = {n: _paths(n) for n in {len(b) - 1 for b in self.bounds}}
        self.nodes: dict[tuple[int, int, int], Myers] = {}
        self.whole: dict[int, tuple[Myers, Myers]] = {}
        self.where: list[list[tuple[int, int]]] = []  # of each distinct piece: items and places in them
        self.automaton = ahocorasick.Automaton()
        known: dict[str, int] = {}
        for i, (_, text) in enumerate(items):
            for k, (a, b) in enumerate(zip(self.bounds[i], self.bounds[i][1:])):
                at = known.setdefault(text[a:b], len(known))
                if at == len(self.where):
                    self.where.append([])
                    self.automaton.add_word(text[a:b], (at, b - a))
                self.where[at].append((i, k))
        if known:
            self.automaton.make_automaton()
        self.any = bool(known)

    def _climb(self, text: str, at: int, i: int, k: int) -> bool:
        """Whether the nodes above piece k of item i, found at `at`, all stay within their budgets.

        A node of n pieces has n - 1 errors at most on the way from some unchanged piece to the
        whole item (else its two halves together had n), so a hit that fails at a node is no match.
        """
        bounds = self.bounds[i]
        for low, high in self.paths[len(bounds) - 1][k]:
            errors = high - low - 1
            begin, end = bounds[low], bounds[high]
            start = at - (bounds[k] - begin)
            stretch = text[max(0, start - errors) : start + end - begin + errors]
            key = (i, low, high)
            node = self.nodes.get(key)
            if node is None:
                node = self.nodes[key] = Myers(self.items[i][1][begin:end])
            if self.items[i][1][begin:end] not in stretch and node.search(stretch, errors) is None:
                return False
        return True

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the closest match of each item found, places in the normalised text."""
        if not self.any:
            return []
        begins: dict[int, set[int]] = {}
        for end, (at, size) in self.automaton.iter(text):
            start = end + 1 - size
            for i, k in self.where[at]:
                if not self.errors[i] and not _apart(text, start, end + 1):
                    continue
                begin = start - self.bounds[i][k]
                if begin not in begins.get(i, ()) and self._near(text, start, end + 1, i, k) and self._climb(text, start, i, k):
                    begins.setdefault(i, set()).add(begin)
        out = []
        for i, found in begins.items():
            item, errors = self.items[i][1], self.errors[i]
            if i not in self.whole:
                self.whole[i] = (Myers(item), Myers(item[::-1]))
            best, done = None, -1
            for begin in sorted(found):
                low, high = max(0, begin - errors), min(len(text), begin + len(item) + errors)
                if high <= done:
                    continue
                done = high
                hit = self.whole[i][0].search(text[low:high], errors)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                back = text[max(0, best[1] - len(item) - errors) : best[1]][::-1]
                begin = best[1] - self.whole[i][1].search(back, best[0])[1]
                out.append((self.items[i][0], best[0], begin, best[1]))
        return sorted(out)

    def _near(self, text: str, start: int, end: int, i: int, k: int) -> bool:
        """For a piece whose parent has two pieces: whether the other one can be there with one error, so that one of its halves is."""
        path = self.paths[len(self.bounds[i]) - 1][k]
        if not path or path[0][1] - path[0][0] != 2:
            return True
        bounds, item = self.bounds[i], self.items[i][1]
        low, high = path[0]
        if k == low:  # the other piece follows
            a, b = bounds[k + 1], bounds[high]
            middle = (a + b) // 2
            if text.startswith(item[a:middle], end):
                return True
            far = end + middle - a
            return item[middle:b] in text[far - 1 : far + 1 + b - middle]
        a, b = bounds[low], bounds[k]
        middle = (a + b) // 2
        if text.endswith(item[middle:b], 0, start):
            return True
        far = start - (b - a)
        return item[a:middle] in text[max(0, far - 1) : far + 1 + middle - a]


def _paths(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the nodes above it, from its parent to the whole, of a tree that halves them."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def cut(low: int, high: int) -> None:
        if high - low > 1:
            middle = (low + high) // 2
            cut(low, middle)
            cut(middle, high)
            for k in range(low, high):
                out[k].append((low, high))

    cut(0, n)
    return out


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 10, out_col: str = "matches") -> DataFrame:
    """docs with the test items that each text holds within percent edits per 100 characters.

    Texts and items are compared by letters and digits in lower case, single spaces between; an
    item too short for an edit must stand between spaces or ends. Of each item the closest
    passage is given (distance, start, end in the normalised text). Null and empty texts hold
    none, items that are null or without a letter or digit are in none; repeated rows stay, and
    so do repeated items that differ in text. A column of docs named like the new one is
    replaced, all others stay.

    The items are a query set of any size: they are dealt into blocks of about BLOCK_CHARS
    characters, and every block is matched against all rows in a pass of its own. So one block
    is in the driver's and the tasks' memory at a time, whatever the number of items.
    """
    given = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    chars = given.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    block_of = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    keep = docs.drop(out_col)
    row = F.struct(*(F.col(_quoted(c)) for c in keep.columns)).alias("row")
    place = keep.columns.index(text_col)

    def wanted(block: int) -> list[tuple[int, str]]:
        return [(r["i"], n) for r in given.where(block_of == block).orderBy("i", "t").collect() if (n := normalised(r["t"]))]

    if blocks == 1:
        found = _with_block(keep.select(row), wanted(0), place, percent)
        return found.select("row.*", F.col("found").alias(out_col))
    # Rows are written once, with a number; the passes write what they find, and no text.
    rows = written(keep.select(row, F.monotonically_increasing_id().alias("number")))
    texts = rows.select(F.struct(F.col("row")[text_col].alias("text")).alias("row"), "number").where(F.col("row.text").isNotNull())
    passes = [written(_with_block(texts, wanted(block), 0, percent).where(F.size("found") > 0).select("number", "found")) for block in range(blocks)]
    matches = reduce(DataFrame.union, passes).groupBy("number").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return rows.join(matches, "number", "left").select("row.*", F.coalesce("found", F.array().cast(MATCHES)).alias(out_col))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _with_block(rows: DataFrame, block: list[tuple[int, str]], place: int, percent: int) -> DataFrame:
    """rows (row, with the text at `place`, and what else they have) with the block's matches as found."""
    shared = rows.sparkSession.sparkContext.broadcast(block)  # about BLOCK_CHARS characters
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = rows.withColumn("found", F.array().cast(MATCHES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, percent)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [[dict(zip(("item_id", "distance", "start", "end"), m)) for m in matcher.match(normalised(t))] if t else [] for t in part.column(0).field(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.distance", "m.start", "m.end")
