"""Secret scans (operator 12): keywords by an automaton, anchored patterns at their hits, checksums last.

One Aho-Corasick pass over a lower-cased text finds the keywords that every pattern but one
begins with; a pattern is tried only where its keyword stands. Runs of hex digits, which have no
keyword, are found by byte class. Tokens that carry a checksum count only if it fits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lower, map_batches, quoted, steps, table, text_bytes

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc32_base62(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of what stands between the prefix and them, in base 62."""
    body = token.partition(b"_")[2]
    value, digits = zlib.crc32(body[:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits.encode() == body[-6:]


@dataclass(frozen=True)
class Kind:
    """A kind of secret: its name, the keywords (lower case) that a match begins with, the pattern at a keyword, the
    group whose size counts and its least size, a checksum, and whether the spans are beyond the base ones."""

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    group: int = 0
    least: int = 1
    valid: str = ""
    more: bool = False


#: Validations by name, so that a kind can be sent to tasks.
CHECKSUMS = {"crc32_base62": crc32_base62}
#: The kinds, in the order in which equal starts are listed.
KINDS = [
    Kind("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", (), rb"[0-9a-f]+", 0, 24),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", 0, 40, "crc32_base62", True),
    Kind("npm", ("npm_",), rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", 0, 40, "crc32_base62", True),
]
SPANS = "array<struct<kind:string,start:long,end:long>>"
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def hex_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of hex digits of that many bytes; texts share none."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _HEX[data], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    cut = offsets[1:-1]
    over = cut[np.searchsorted(start, cut, "left") > np.searchsorted(end, cut, "right")]
    if len(over):  # a run that goes on over the end of a text is two
        start, end = np.sort(np.append(start, over)), np.sort(np.append(end, over))
    long = end - start >= least
    return start[long], end[long]


class Scanner:
    """The kinds' automaton and patterns; built once for each task."""

    def __init__(self, kinds: list[Kind]):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        by_word: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                by_word.setdefault(word, []).append(i)
        for word, of in by_word.items():
            self.machine.add_word(word, (len(word), of))
        if by_word:
            self.machine.make_automaton()

    def hits(self, data: np.ndarray) -> list[list[int]]:
        """For each kind the places of its keywords, in order. Bytes count as Latin letters, so that places are bytes."""
        out: list[list[int]] = [[] for _ in self.kinds]
        if len(self.machine) and len(data):
            for last, (size, of) in self.machine.iter(lower(data).tobytes().decode("latin-1")):
                for i in of:
                    out[i].append(last - size + 1)
        return [sorted(x) for x in out]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, kind, end) in code points, by start and then kind."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        raw = data.tobytes()
        found: list[tuple[int, int, int]] = []
        for i, (kind, pattern, places) in enumerate(zip(self.kinds, self.patterns, self.hits(data))):
            if not kind.keywords:
                start, end = hex_runs(data, offsets, kind.least)
                found += [(a, i, b) for a, b in zip(start.tolist(), end.tolist())]
                continue
            done = 0
            ends = offsets[np.searchsorted(offsets, places, "right")].tolist()
            for place, limit in zip(places, ends):
                if place < done:
                    continue
                match = pattern.match(raw, place, limit)
                if not match:
                    continue
                done = match.end()
                if len(match[kind.group]) >= kind.least and (not kind.valid or CHECKSUMS[kind.valid](match[0])):
                    found.append((place, i, done))
        if not found:
            return out
        # Bytes to code points: bytes that go on with a code point don't count.
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        found.sort()
        spans = np.array(found)
        row = np.searchsorted(offsets, spans[:, 0], "right") - 1
        start, end = (begins[spans[:, k]] - begins[offsets[row]] for k in (0, 2))
        for r, a, i, b in zip(row.tolist(), start.tolist(), spans[:, 1].tolist(), end.tolist()):
            out[r].append((a, i, b))
        return out


def with_secrets(docs: DataFrame, text_col: str = "text", kinds: list[Kind] = KINDS, out_col: str = "secrets") -> DataFrame:
    """docs with the secrets of each text: kind, start and end in code points, by start and then in the order of kinds.

    Matches of a kind don't overlap (the leftmost counts); those of different kinds may. Null and
    empty texts have none; repeated rows stay. A column of docs named like the new one is
    replaced, all others stay. The kinds are a parameter, so their tables go to every task.
    """
    keep = docs.drop(out_col)
    names = keep.columns
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in batches:
            offsets, data = text_bytes(batch.column(names.index(text_col)))
            for a, b in steps(offsets):
                rows = scanner.scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                spans = pa.array([[{"kind": kinds[i].name, "start": s, "end": e} for s, i, e in row] for row in rows], kind)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, spans], names=[*names, out_col])

    return map_batches(keep, run, names, f"{quoted(out_col)} {SPANS}")


def redacted(docs: DataFrame, text_col: str = "text", kinds: list[Kind] = KINDS, mark: str = "*") -> DataFrame:
    """docs with every code point of a secret replaced by mark (one character); the texts' lengths stay. Null texts stay null."""
    column = "_secrets"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    own = F.col(quoted(text_col))

    def hide(text, span):
        return F.concat(F.substring(text, F.lit(1), span["start"].cast("int")), F.repeat(F.lit(mark), (span["end"] - span["start"]).cast("int")), F.substring(text, span["end"].cast("int") + 1, F.length(text)))

    found = with_secrets(docs, text_col, kinds, column)
    return found.select(*(F.aggregate(column, own, hide).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of the secrets of every document (null and empty texts: none, a null id stays null)."""
    base = [k.name for k in KINDS if not k.more]
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    digest = F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256)
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in base), digest.alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
