"""Byte-level BPE (operator 9): encoding and decoding by a public rank file.

Texts are cut without regular expressions: every code point gets a class, every class is a
transition function over a few states, and the functions are composed block by block (an
associative scan), which gives the state, and so the boundary, at each code point. The slices
are merged pair by pair, with a cache of slices already merged.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_batches, quoted, slice_hashes, steps, table, text_bytes

# Classes of code points.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: White space of the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols: a class and what of its surroundings matters.
S_LETTER, S_SHORT, S_FIRST, S_NUMBER, S_OTHER, S_QUOTE, S_JOIN, S_LONE, S_WHITE = range(9)
# States after a code point: FREE (the next one starts a slice), inside a run, after a joining space,
# after a quote that starts a slice, after the first letter of a two-letter ending.
FREE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, JOINED, QUOTED, ENDING = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a slice starts here", for each symbol and state."""
    to, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol in (S_LETTER, S_SHORT, S_FIRST):
        to[symbol] = IN_LETTER
        cut[symbol, [IN_LETTER, JOINED]] = False
    to[S_SHORT, QUOTED], cut[S_SHORT, QUOTED] = FREE, False
    to[S_FIRST, QUOTED], cut[S_FIRST, QUOTED] = ENDING, False
    for symbol in (S_LETTER, S_SHORT, S_FIRST):
        to[symbol, ENDING], cut[symbol, ENDING] = FREE, False
    to[S_NUMBER] = IN_NUMBER
    cut[S_NUMBER, [IN_NUMBER, JOINED]] = False
    to[S_OTHER] = IN_OTHER
    to[S_QUOTE] = QUOTED
    to[S_QUOTE, [IN_OTHER, QUOTED, JOINED]] = IN_OTHER
    for symbol in (S_OTHER, S_QUOTE):
        cut[symbol, [IN_OTHER, QUOTED, JOINED]] = False
    to[S_JOIN] = JOINED
    to[S_LONE] = FREE
    to[S_WHITE] = IN_WHITE
    cut[S_WHITE, IN_WHITE] = False
    return to, cut


NEXT, CUT = _automaton()
BLOCK = 256
_classes = np.full(0x110000, 255, np.uint8)


def classes(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for each code point; looked up once for each distinct one."""
    out = _classes[points]
    if (out == 255).any():
        for p in np.unique(points[out == 255]).tolist():
            kind = unicodedata.category(chr(p))[0]
            _classes[p] = SPACE if p in WHITE_SPACE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        out = _classes[points]
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point; starts: where texts begin (none is empty)."""
    n = len(points)
    kind = classes(points)
    ends = np.zeros(n, bool)
    ends[starts[1:] - 1] = ends[n - 1] = True
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[ends] = SPACE
    letter_after = np.zeros(n, np.uint32)
    letter_after[:-1] = points[1:]
    letter_after[ends] = 0
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE], np.uint8)[kind]
    symbol[(points == 115) | (points == 116) | (points == 109) | (points == 100)] = S_SHORT  # s t m d
    two = ((points == 114) | (points == 118)) & (letter_after == 101) | (points == 108) & (letter_after == 108)  # re ve ll
    symbol[two] = S_FIRST
    symbol[points == 39] = S_QUOTE
    lone = (kind == SPACE) & (after != SPACE)
    symbol[lone] = S_LONE
    symbol[lone & (points == 32)] = S_JOIN

    # A text's first code point forgets what stood before: twice the symbols, the second half as from FREE.
    to = np.concatenate([NEXT, np.repeat(NEXT[:, FREE : FREE + 1], 8, 1)])
    cut = np.concatenate([CUT, np.ones_like(CUT)])
    symbol[starts] += 9
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, S_WHITE, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T).astype(np.intp)
    flat = to.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8))
    for row in grid:  # each block's transition function
        whole = flat[(row * 8)[:, None] + whole]
    entry, state = np.zeros(blocks, np.uint8), FREE
    for b, function in enumerate(whole.tolist()):  # functions composed over the blocks
        entry[b] = state
        state = function[state]
    found = np.empty((BLOCK, blocks), bool)
    flat_cut = cut.ravel()
    for i, row in enumerate(grid):
        at = row * 8 + entry
        found[i] = flat_cut[at]
        entry = flat[at]
    return found.T.ravel()[:n]


@functools.lru_cache(maxsize=2)
def _ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank (the leftmost of equals) is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long slices, with a heap and links instead of list searches."""
    import heapq

    n = len(parts)
    left, right, token = list(range(-1, n - 1)), list(range(1, n + 1)), list(parts)
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i]
        if token[i] is None or j >= n or token[i] + token[j] != joined:
            continue
        token[i], token[j] = joined, None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < n and (r := ranks.get(token[a] + token[b])) is not None:
                heapq.heappush(heap, (r, a, token[a] + token[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = right[i]
    return out


@functools.lru_cache(maxsize=2)
def _pairs(lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys left id * 2^32 + right id of all pairs of tokens that make a token, and that token's id."""
    ranks = _ranks(lines)
    keys, made = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                made.append(rank)
    order = np.argsort(np.array(keys, np.int64))
    return np.array(keys, np.int64)[order], np.array(made, np.int64)[order]


NONE = 1 << 40


def merge_all(grid: np.ndarray, sizes: np.ndarray, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge() for many slices at once. grid: a row of byte tokens for each, padded; sizes: bytes of each. Ids and their numbers."""
    width = grid.shape[1]

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, made[at], NONE)

    out, out_sizes = grid, sizes.copy()
    row = np.arange(len(grid))
    columns = np.arange(width)
    tokens = grid.copy()
    ranks = np.full((len(grid), width), NONE, np.int64)
    pair = columns[None, :-1] < sizes[:, None] - 1
    ranks[:, :-1][pair] = rank(tokens[:, :-1][pair], tokens[:, 1:][pair])
    left = sizes.copy()
    while len(row):
        at = ranks.argmin(1)
        every = np.arange(len(row))
        best = ranks[every, at]
        going = best < NONE
        if not going.all():
            done = ~going
            out[row[done]], out_sizes[row[done]] = tokens[done], left[done]
            row, tokens, ranks, left, at, best = row[going], tokens[going], ranks[going], left[going], at[going], best[going]
            every = np.arange(len(row))
            if not len(row):
                break
        left = left - 1
        after = columns[None, :-1] > at[:, None]
        tokens[:, :-1] = np.where(after, tokens[:, 1:], tokens[:, :-1])
        ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
        tokens[every, at] = best
        has = at + 1 < left
        ranks[every, at] = NONE
        r, c = every[has], at[has]
        ranks[r, c] = rank(tokens[r, c], tokens[r, c + 1])
        r, c = every[at > 0], at[at > 0]
        ranks[r, c - 1] = rank(tokens[r, c - 1], tokens[r, c])
    return out, out_sizes


class Encoder:
    """Encodes batches of texts; keeps the merged slices that it has seen, CACHE of them and a batch's at most.

    Slices are looked up by a hash of their bytes and compared byte by byte with what is found;
    one that only shares the hash is merged by itself.
    """

    CACHE = 200_000

    def __init__(self, lines: bytes):
        self.ranks = _ranks(lines)
        self.keys, self.made = _pairs(lines)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.firsts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.begins, self.spans = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices in a row, and each one's number of ids."""
        order = np.argsort(size, kind="stable")
        start, size = start[order], size[order]
        found, numbers = [], []
        bounds = np.searchsorted(size, [9, 13, 17, 25, 33, 65]).tolist()
        for a, b in zip([0, *bounds[:-1]], bounds):
            if a < b:
                width = int(size[b - 1])
                cells = np.minimum(start[a:b, None] + np.arange(width + 1), len(data) - 1)
                grid, n = merge_all(self.byte_ids[data[cells]], size[a:b], self.keys, self.made)
                found.append(grid[np.arange(width + 1) < n[:, None]])
                numbers.append(n)
        for s, n in zip(start[bounds[-1] :].tolist(), size[bounds[-1] :].tolist()):
            ids = merge(data[s : s + n].tobytes(), self.ranks)
            found.append(np.array(ids, np.int64))
            numbers.append(np.array([len(ids)]))
        numbers, ids = np.concatenate(numbers), np.concatenate(found)
        firsts = np.cumsum(numbers) - numbers
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return _gather(ids, firsts[back], numbers[back]).astype(np.int32), numbers[back]

    def _add(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Merges slices and keeps them; their places."""
        ids, numbers = self._merged(data, start, size)
        place = len(self.firsts) + np.arange(len(start))
        self.firsts = np.concatenate([self.firsts, len(self.ids) + np.cumsum(numbers) - numbers])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, numbers])
        self.begins = np.concatenate([self.begins, len(self.store) + np.cumsum(size) - size])
        self.store, self.spans = np.concatenate([self.store, _gather(data, start, size)]), np.concatenate([self.spans, size])
        return place

    def _equal(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether slices that lie side by side (all of data) have the bytes of the kept ones at code."""
        good = self.spans[code] == size
        same = np.ones(len(start), np.int64)
        some = np.flatnonzero(good)
        if len(some):
            mine, kept = _gather(data, start[some], size[some]), _gather(self.store, self.begins[code[some]], size[some])
            same[some] = np.add.reduceat((mine != kept).astype(np.int64), np.cumsum(size[some]) - size[some]) == 0
        return good & (same > 0)

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each id's end in its text's bytes, and where each text's ids begin (one more entry)."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
        full = offsets[:-1][np.diff(offsets) > 0]
        start = heads[np.flatnonzero(boundaries(points, np.searchsorted(heads, full)))]
        end = np.append(start[1:], len(data))
        size = end - start
        hashes = slice_hashes(data, start, end)
        distinct, sample, code = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        if len(self.hashes) > self.CACHE and not known.all():
            self._clear()
            known[:] = False
        if not known.all():
            new = sample[~known]
            place = self._add(data, start[new], size[new])
            hashes = np.concatenate([self.hashes, distinct[~known]])
            at = np.concatenate([self.at, place])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.at = hashes[order], at[order]
        code = self.at[np.searchsorted(self.hashes, distinct)][code]
        other = np.flatnonzero(~self._equal(data, start, size, code))
        if len(other):  # another slice has this one's hash
            code[other] = self._add(data, start[other], size[other])
        lengths = self.lengths[code]
        ids = _gather(self.ids, self.firsts[code], lengths)
        begins = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(start, offsets)]
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        ends = ends[1:] - np.repeat(ends[begins[:-1]], np.diff(begins))
        return ids, ends.astype(np.int32), begins


def _gather(values: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[f : f + n] of all f and n, one after the other."""
    run = np.cumsum(lengths)
    return values[np.repeat(firsts - (run - lengths), lengths) + np.arange(run[-1] if len(run) else 0)]


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values))


def _ranks_file(spark: SparkSession, ranks_path: str):
    """The rank file (about 1 MB, a fixed public vocabulary) goes from the driver to the tasks."""
    with open(ranks_path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "token_ids", ends_col: str = "token_ends") -> DataFrame:
    """df with token ids and each token's end offset in the text's UTF-8 bytes.

    Null and empty texts give empty arrays; repeated rows stay. Columns of df named like the new
    ones are replaced, all others stay as they are.
    """
    lines = _ranks_file(df.sparkSession, ranks_path)
    keep = df.drop(ids_col, ends_col)
    names = keep.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines.value)
        for batch in batches:
            column = batch.column(names.index(text_col))
            offsets, data = text_bytes(column)
            for a, b in steps(offsets, 2 << 20):
                ids, ends, begins = encoder.encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, begins), _lists(ends, begins)], names=[*names, ids_col, ends_col])

    return map_batches(keep, run, names, f"{quoted(ids_col)} array<int>, {quoted(ends_col)} array<int>")


class Decoder:
    """Bytes of ids, by the tokens of a rank file."""

    def __init__(self, lines: bytes):
        ranks = _ranks(lines)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.store = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
        """A binary for each row, whose ids begin at begins (one more entry)."""
        data = _gather(self.store, self.firsts[ids], self.sizes[ids])
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[begins]
        return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give no bytes."""
    lines = _ranks_file(df.sparkSession, ranks_path)
    keep = df.drop(out_col)
    names = keep.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lines.value)
        for batch in batches:
            column = batch.column(names.index(ids_col))
            offsets = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for a, b in steps(offsets, 1 << 19):
                values = decoder.decode(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, values], names=[*names, out_col])

    return map_batches(keep, run, names, f"{quoted(out_col)} binary")


def encode_decode(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """df without its text, with token ids and the bytes that these stand for: encode and decode in one worker of a task, not two.

    Steps are of 256 KB of text, as what a step holds is many times its text.
    """
    lines = _ranks_file(df.sparkSession, ranks_path)
    keep = df.drop(ids_col, out_col)
    names = keep.columns
    kept = [n for n in names if n != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(lines.value), Decoder(lines.value)
        for batch in batches:
            offsets, data = text_bytes(batch.column(names.index(text_col)))
            for a, b in steps(offsets, 1 << 18):
                ids, _, begins = encoder.encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in kept), _lists(ids, begins), decoder.decode(ids, begins)], names=[*kept, ids_col, out_col])

    return map_batches(keep, run, kept, f"{quoted(ids_col)} array<int>, {quoted(out_col)} binary")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of the ids and of the bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path)


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of each row of docs (doc_id, text), null ids and repeated rows too."""
    coded = encode(docs, ranks_path).drop("text", "token_ends")
    coded = coded.select("doc_id", "token_ids", F.sha2(F.array_join("token_ids", " ").cast("binary"), 256).alias("ids_sha256"))
    back = decode(coded, ranks_path)
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
