"""URL filters (operator 7): all glob rules at once, by a bit-parallel automaton.

Rules become positions of one bit string over as many 64-bit words as it takes (multiword
Shift-And). One step over a column of characters moves the states of all URLs and all rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, table, text_bytes

ALLOW, BLOCK = "allow", "block"
#: (verdict, rule): a host and the beginning of a path, as host/path.
RULES = [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")]
#: Globs over the whole canonical URL (host and path) that block a URL which no rule fits.
GLOBS = ["*spam*", "*casino*", "*cheap-pills*"]
#: Cells (characters of URLs) that one step of the automaton holds at most, but for a single longer URL.
CELLS = 1 << 20
END = 256


@dataclass
class Automaton:
    """moves, stays: for each character (and END) the words of states reached by it, and kept by it."""

    moves: np.ndarray
    stays: np.ndarray
    start: np.ndarray
    finals: list[int]


def automaton(patterns: list[list[tuple[str, frozenset[int] | None]]]) -> Automaton:
    """patterns: of ("char", {bytes}), or ("star", {bytes that it runs over}) which matches any number of them."""
    bits = sum(1 + sum(kind == "char" for kind, _ in p) for p in patterns)
    words = max(-(-bits // 64), 1)
    moves, stays, start = np.zeros((257, words), np.uint64), np.zeros((257, words), np.uint64), np.zeros(words, np.uint64)
    finals, at = [], 0

    def put(masks: np.ndarray, bit: int, over) -> None:
        for b in over:
            masks[b, bit // 64] |= np.uint64(1 << bit % 64)

    for pattern in patterns:
        start[at // 64] |= np.uint64(1 << at % 64)
        put(stays, at, [END])
        for kind, over in pattern:
            if kind == "char":
                at += 1
                put(moves, at, over)
                put(stays, at, [END])
            else:
                put(stays, at, over)
        finals.append(at)
        at += 1
    return Automaton(moves, stays, start, finals)


def run(machine: Automaton, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which patterns match each whole text: a row of booleans for each."""
    n = len(offsets) - 1
    out = np.zeros((n, len(machine.finals)), bool)
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    one = np.uint64(1)
    a = 0
    while a < n:
        fits = np.arange(1, n - a + 1) * np.maximum(size[order[a:]], 1) <= CELLS
        b = a + max(int(fits.sum()) if fits.all() else int(np.argmin(fits)), 1)
        rows = order[a:b]
        width = int(size[rows].max())
        state = np.broadcast_to(machine.start, (len(rows), len(machine.start))).copy()
        for i in range(width):
            char = np.full(len(rows), END)
            there = size[rows] > i
            char[there] = data[offsets[rows[there]] + i]
            shifted = state << one
            shifted[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (shifted & machine.moves[char]) | (state & machine.stays[char])
        for k, bit in enumerate(machine.finals):
            out[rows, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one > 0
        a = b
    return out


_ANY = frozenset(range(256))
_IN_HOST = _ANY - {ord("/")}


def _chars(text: str) -> list[tuple[str, frozenset[int]]]:
    return [("char", frozenset([b])) for b in text.encode()]


def rule_pattern(rule: str) -> list[tuple[str, frozenset[int] | None]]:
    """A rule as a pattern over ".host/path": any subdomains, the host, the path and what follows."""
    host, slash, path = rule.partition("/")
    return [("star", _IN_HOST), *_chars("." + host.lower()), *_chars(slash + path), ("star", _ANY)]


def glob_pattern(glob: str) -> list[tuple[str, frozenset[int] | None]]:
    """A glob over ".host/path": * any text, ? any byte."""
    out: list = [("star", frozenset([ord(".")]))]
    for c in glob:
        out += [("star", _ANY)] if c == "*" else [("char", _ANY)] if c == "?" else _chars(c)
    return out


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES, globs: list[str] = GLOBS) -> DataFrame:
    """pages without url_col but with host, path, rule and verdict.

    host: from behind the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path: from
    there to `?`, `#` or the end; both empty for a null URL or one without `://`. The longest
    fitting rule gives the verdict (the first of equally long ones); without one, a glob that
    matches host and path blocks and all else is allowed. Repeated rows stay. Columns of pages
    named like the new ones are replaced, all others stay. Rules and globs are parameters, so their tables go to every task.
    """
    new = ["host", "path", "rule", "verdict"]
    keep = pages.drop(*new)
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substring({_sql(url_col)}, instr({_sql(url_col)}, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    ready = keep.select(*(F.col(_sql(c)) for c in keep.columns if c != url_col), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))
    machine = automaton([rule_pattern(r) for _, r in rules] + [glob_pattern(g) for g in globs])
    names = ready.columns
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), k))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.compute.binary_join_element_wise("", batch.column(names.index("host")), batch.column(names.index("path")), "")
            canonical = pa.compute.binary_join_element_wise(pa.scalar("."), both, "")
            hits = run(machine, *text_bytes(canonical))
            rule = np.full(batch.num_rows, -1)
            for k in reversed(ranked):
                rule[hits[:, k]] = k
            blocked = hits[:, len(rules) :].any(1)
            verdict = [rules[k][0] if k >= 0 else BLOCK if x else ALLOW for k, x in zip(rule.tolist(), blocked.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([rules[k][1] if k >= 0 else None for k in rule.tolist()], pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"])

    return map_batches(ready, match, names, "rule string, verdict string")


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


OP7_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM a),
c AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host || path, 'spam') OR contains(host || path, 'casino') OR contains(host || path, 'cheap-pills') THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
