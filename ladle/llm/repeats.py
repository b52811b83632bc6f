"""Removal of repeated passages (operator 5), exact to the byte.

A byte goes if a string of `length` bytes that covers it also starts in a document of smaller
id. The suffixes are sorted only as far as the question needs, to `length` bytes, and only where
a repeat is possible:

1. Every window of `length` bytes has an anchor, the smallest hash among its k-mers. Windows with
   the same anchor form a context. Anchors are dealt to partitions by k-mer and sorted there:
   a context that a smaller document has too is covered whole. Contexts that share an anchor and
   the bytes of one side of it may share windows; they are asked for.
2. The windows of the contexts asked for are dealt by their own hash and sorted likewise.
   Both kinds are dealt by ranges of hashes, as many as the input asks for; Spark sorts the
   ranges of a partition, and a task judges one range after the other.
3. Covered windows go back to their documents, which drop the covered bytes.

Equal strings have equal anchors, so no repeat is missed. Within a task, a context or window
that several documents have is sent once, for the smallest id; the others are covered already.
So a group of copies, however large, meets as one entry from each task.

The method asked for (external induced sorting of all suffixes, with priority queues on disk)
sorts 840 million suffixes for half a gigabyte; see the README for why it isn't used.
"""

from __future__ import annotations


import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import frugal, lanes, mix, slice_hashes, steps, table, text_bytes, with_fields, written

KMER = 12
#: Entries that a task gathers before it sorts and sends them: so many, or SENT for each range of hashes, so that what is sent
#: at once for a range doesn't shrink as ranges grow in number, but MOST at most.
GATHERED, SENT, MOST = 300_000, 2000, 2_000_000
#: Bytes of text whose contexts are found in one step, some thirty numbers for each byte.
CONTEXT_BYTES = 1 << 17
#: A k-mer with more contexts than this in one task: all its contexts are asked for.
CROWDED = 1000
#: Entries that one range of hashes holds, about; a task judges one range after the other. HELD: entries at which it sheds those
#: that are settled already.
RANGE, HELD = 700_000, 2_000_000
COVERED, ASKED = 0, 1


def pack(**columns: np.ndarray) -> bytes:
    """Arrays by name: what they are called and what they hold, then their bytes one after the other."""
    head = json.dumps([(k, x.dtype.str, x.shape) for k, x in columns.items()]).encode()
    return zstandard.compress(b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(x).tobytes() for x in columns.values())]), 1)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    data = zstandard.decompress(blob)
    at = 4 + int.from_bytes(data[:4], "little")
    out = {}
    for k, kind, shape in json.loads(data[4:at]):
        size = math.prod(shape)
        out[k] = np.frombuffer(data, np.uint8, size * np.dtype(kind).itemsize, at).copy().view(kind).reshape(shape)
        at += size * np.dtype(kind).itemsize
    return out


def _low_planes(values: np.ndarray, count: int) -> dict[str, np.ndarray]:
    """The low `count` bytes of 64-bit values, byte by byte, as they compress best."""
    return values.view(np.uint8).reshape(-1, 8)[:, :count].T.copy()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def _bounded_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - span : width - span + n])
    return out


def _kmers(data: np.ndarray) -> np.ndarray:
    """A hash of the KMER bytes from each place on; it deals and groups, equality is judged by others."""
    at = lanes(data)
    n = len(data) - KMER + 1
    x = at[:n] * np.uint64(0xD1342543DE82EF95) + (at[8 : 8 + n] & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The contexts of texts of at least `length` bytes: row, first window (from the text's begin), windows, and hashes.

    kmer: of the anchor (mixed anew, as anchors have small hashes); whole: of all bytes of the context; left, right: of the anchor with half
    of what a window needs besides it on one side (a shared window agrees on one of them).
    """
    side = -(-(length - KMER) // 2)
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return {"row": none, "first": none, "number": none} | dict.fromkeys(["kmer", "whole", "left", "right"], np.zeros(0, np.uint64))
    hashes = _kmers(data)
    values = (hashes & np.uint64((1 << 64) - (1 << 32))) | np.arange(len(hashes), dtype=np.uint64)
    lowest = (_bounded_min(values, length - KMER + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), windows)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[owner]
    lowest = lowest[window]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (lowest[1:] != lowest[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(owner)))
    row, start, anchor = owner[first], window[first], lowest[first]
    low = np.maximum(anchor - side, offsets[row])
    high = np.minimum(anchor + KMER + side, offsets[row + 1])
    return {"row": row, "first": start - offsets[row], "number": number, "kmer": mix(hashes[anchor]), "whole": slice_hashes(data, start, start + number + length - 1) >> np.uint64(24), "left": slice_hashes(data, low, anchor + KMER), "right": slice_hashes(data, anchor, high)}


def window_hashes(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits more of a hash of data[start : start + length]."""
    a = slice_hashes(data, start, start + length // 2)
    b = slice_hashes(data, start + length // 2, start + length)
    return mix(a + b * np.uint64(0x9E3779B97F4A7C15)), ((a * np.uint64(0xD1342543DE82EF95) ^ b) >> np.uint64(32)).astype(np.uint32)


def _ranges(keys: np.ndarray, count: int) -> np.ndarray:
    """Range of each key: by its high bits, so that sorted keys lie in order of range."""
    return ((keys >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


_BLOBS = "range int, blob binary"
#: doc and copy (a hash of the text, which tells rows apart that repeat an id; 0 where none does) name a row.
_CODES = "doc long, copy int, first int, number int, kind int"


def _codes(doc: np.ndarray, copy: np.ndarray, first: np.ndarray, number: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *(pa.array(x.astype(np.int32), pa.int32()) for x in (copy, first, number, kind))], names=["doc", "copy", "first", "number", "kind"])


def _shared_elsewhere(key: np.ndarray, doc: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Entries with another entry of equal key, other document and other context."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    if not len(begin):
        return np.zeros(0, bool)
    d, w = doc[order], whole[order]
    mixed = (np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)) & (np.minimum.reduceat(w, begin) < np.maximum.reduceat(w, begin))
    out = np.zeros(len(k), bool)
    out[order] = np.repeat(mixed, np.diff(np.append(begin, len(k))))
    return out


def _above_first(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Entries whose key (high, low) also belongs to a smaller document."""
    order = np.lexsort((doc, low, high))
    h, k, d = high[order], low[order], doc[order]
    begin = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))[: len(h)]
    lowest = d[begin][np.cumsum(begin) - 1] if len(d) else d
    out = np.zeros(len(k), bool)
    out[order] = d > lowest
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Arrays by name, one after the other; parts is left empty."""
    out = {k: np.concatenate([p.pop(k) for p in parts]) for k in list(parts[0])} if parts else {}
    parts.clear()
    return out


class _Names:
    """Ids and copies of the texts whose entries are being gathered; an entry holds its text's place here."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.before = 0

    def add(self, docs: np.ndarray, copies: np.ndarray) -> None:
        self.before = sum(len(d) for d, _ in self.parts)
        self.parts.append((docs, copies))

    def sent(self) -> None:
        """Entries were sent; those of the last texts may go on."""
        self.parts, self.before = self.parts[-1:], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([d for d, _ in self.parts]), np.concatenate([c for _, c in self.parts])


def _named(texts: np.ndarray, docs: np.ndarray, copies: np.ndarray) -> dict[str, np.ndarray]:
    """The ids and copies of the texts of entries, each once, and where an entry finds its own."""
    some, row = np.unique(texts, return_inverse=True)
    return {"docs": _low_planes(docs[some], 8), "copies": copies[some], "row": row.astype(np.uint32 if len(some) > 65535 else np.uint16)}


def _names_of(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return _from_planes(x["docs"]).view(np.int64)[x["row"]], x["copies"][x["row"]]


def _blobs(ranges: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "blob"])


def _send_contexts(texts: DataFrame, length: int, count: int) -> DataFrame:
    """texts: doc, copy, text."""
    enough = min(max(GATHERED, SENT * count), MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[dict[str, np.ndarray]] = []
        names = _Names()

        def out() -> Iterator[pa.RecordBatch]:
            e = _joined(gathered)
            docs, copies = names.all()
            known = _above_first(e["kmer"], e["whole"], docs[e["text"]])
            kmers, at, number = np.unique(e["kmer"], return_inverse=True, return_counts=True)
            crowded = number > CROWDED
            asked = crowded[at] & ~known
            order = np.argsort(e["kmer"], kind="stable")
            wild = kmers[crowded]
            bounds, wild_bounds = (np.searchsorted(_ranges(keys, count), np.arange(count + 1)) for keys in (e["kmer"][order], wild))
            for r in np.flatnonzero((np.diff(bounds) > 0) | (np.diff(wild_bounds) > 0)).tolist():
                i = order[bounds[r] : bounds[r + 1]]
                s, k, a = i[~known[i] & ~asked[i]], i[known[i]], i[asked[i]]
                both = np.concatenate([s, k, a])
                yield _blobs([r], [pack(n=np.array([len(s), len(k), len(a)]), kmer=_low_planes(e["kmer"][s], 8), whole=_low_planes(e["whole"][s], 5), left=e["left"][s], right=e["right"][s], **_named(e["text"][both], docs, copies), first=e["first"][both], number=e["number"][both], wild=wild[wild_bounds[r] : wild_bounds[r + 1]])])
            names.sent()

        kinds = {"left": np.uint16, "right": np.uint16, "first": np.uint32, "number": np.uint8 if length < 267 else np.uint32}
        for batch in batches:
            docs, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names.add(docs, copies)
            offsets, data = text_bytes(batch.column(2))
            for a, b in steps(offsets, CONTEXT_BYTES):
                found = contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                text = (found.pop("row") + a + names.before).astype(np.int32)
                gathered.append({k: x.astype(kinds.get(k, x.dtype)) for k, x in found.items()} | {"text": text})
                if sum(len(g["text"]) for g in gathered) > enough:
                    yield from out()
        if gathered:
            yield from out()

    return texts.mapInArrow(frugal(run), _BLOBS)


def _judge_contexts(blobs: DataFrame) -> DataFrame:
    """Codes of the contexts that are covered or asked for. blobs come range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, np.ndarray]] = []
        wild = np.zeros(0, np.uint64)
        here = -1

        def coded(e: dict[str, np.ndarray], some: np.ndarray, kind: int) -> pa.RecordBatch:
            return _codes(e["doc"][some], e["copy"][some], e["first"][some], e["number"][some], np.full(int(some.sum()), kind))

        def shed() -> Iterator[pa.RecordBatch]:
            """Settles what can't change any more: covered contexts, and those of k-mers with very many contexts."""
            nonlocal wild
            e = _joined(found)
            covered = _above_first(e["kmer"], e["whole"], e["doc"])
            kmers, number = np.unique(e["kmer"][~covered], return_counts=True)
            wild = np.union1d(wild, kmers[number > 100 * CROWDED])
            asked = np.isin(e["kmer"], wild) & ~covered
            yield coded(e, covered, COVERED)
            yield coded(e, asked, ASKED)
            found.append({k: x[~covered & ~asked] for k, x in e.items()})

        def finish() -> Iterator[pa.RecordBatch]:
            e = _joined(found)
            if e and len(e["doc"]):
                covered = _above_first(e["kmer"], e["whole"], e["doc"])
                base = mix(e["kmer"])
                asked = np.isin(e["kmer"], wild)
                for side, salt in (("left", 1), ("right", 2)):
                    asked |= _shared_elsewhere(base ^ mix(e[side].astype(np.uint64) + np.uint64(salt << 20)), e["doc"], e["whole"])
                yield coded(e, covered, COVERED)
                yield coded(e, asked & ~covered, ASKED)

        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != here:
                    yield from finish()
                    here, wild = r, np.zeros(0, np.uint64)
                x = unpack(blob.as_py())
                n, k, a = x["n"].tolist()
                (doc, copy), first, number = _names_of(x), x["first"], x["number"]
                if k + a:
                    yield _codes(doc[n:], copy[n:], first[n:], number[n:], np.repeat([COVERED, ASKED], [k, a]))
                wild = np.union1d(wild, x["wild"])
                found.append({"kmer": _from_planes(x["kmer"]), "whole": _from_planes(x["whole"]), "left": x["left"], "right": x["right"], "doc": doc[:n], "copy": copy[:n], "first": first[:n], "number": number[:n]})
                if sum(len(f["doc"]) for f in found) > HELD:
                    yield from shed()
        yield from finish()

    return blobs.mapInArrow(frugal(run), _CODES)


def _send_windows(rows: DataFrame, length: int, text_at: int, count: int) -> DataFrame:
    """rows: doc, copy, row (the caller's columns, the text at `text_at`), asked: array<struct<first, number>>."""
    enough = min(max(GATHERED, SENT * count), MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[dict[str, np.ndarray]] = []
        names = _Names()

        def out() -> Iterator[pa.RecordBatch]:
            e = _joined(gathered)
            docs, copies = names.all()
            known = _above_first(e["high"], e["low"], docs[e["text"]])
            order = np.argsort(e["high"], kind="stable")
            bounds = np.searchsorted(_ranges(e["high"][order], count), np.arange(count + 1))
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                i = order[bounds[r] : bounds[r + 1]]
                s, k = i[~known[i]], i[known[i]]
                both = np.concatenate([s, k])
                yield _blobs([r], [pack(n=np.array([len(s), len(k)]), high=_low_planes(e["high"][s], 8), low=e["low"][s], **_named(e["text"][both], docs, copies), first=e["first"][both])])
            names.sent()

        for batch in batches:
            docs, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names.add(docs, copies)
            offsets, data = text_bytes(batch.column(2).field(text_at))
            asked = batch.column(3)
            for a, b in steps(offsets):
                part = asked.slice(a, b - a)
                lengths = pa.compute.list_value_length(part).to_numpy()
                flat = part.flatten()
                first, number = (flat.field(j).to_numpy().astype(np.int64) for j in (0, 1))
                row = np.repeat(np.arange(a, b), lengths)
                each = np.repeat(np.arange(len(row)), number)
                place = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number)
                # A context can be asked for twice; its windows count once.
                both = np.unique(row[each] << 40 | place)
                row, place = both >> 40, both & ((1 << 40) - 1)
                high, low = window_hashes(data[offsets[a] : offsets[b]], offsets[row] - offsets[a] + place, length)
                gathered.append({"high": high, "low": low, "text": (row + names.before).astype(np.int32), "first": place.astype(np.uint32)})
                if sum(len(g["text"]) for g in gathered) > enough:
                    yield from out()
        if gathered:
            yield from out()

    return rows.mapInArrow(frugal(run), _BLOBS)


def _judge_windows(blobs: DataFrame) -> DataFrame:
    """Runs of covered windows. blobs come range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, np.ndarray]] = []
        here = -1

        def shed() -> Iterator[pa.RecordBatch]:
            """Gives the covered windows and keeps the others."""
            e = _joined(found)
            if e and len(e["doc"]):
                covered = _above_first(e["high"], e["low"], e["doc"])
                yield _runs(e["doc"][covered], e["copy"][covered], e["first"][covered])
                found.append({k: x[~covered] for k, x in e.items()})

        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if r != here:
                    yield from shed()
                    found.clear()
                    here = r
                x = unpack(blob.as_py())
                n, k = x["n"].tolist()
                (doc, copy), first = _names_of(x), x["first"].astype(np.int64)
                if k:
                    yield _runs(doc[n:], copy[n:], first[n:])
                found.append({"high": _from_planes(x["high"]), "low": x["low"], "doc": doc[:n], "copy": copy[:n], "first": first[:n]})
                if sum(len(f["doc"]) for f in found) > HELD:
                    yield from shed()
        yield from shed()

    return blobs.mapInArrow(frugal(run), _CODES)


def _by_range(blobs: DataFrame, count: int, parts: int) -> DataFrame:
    """blobs dealt to partitions, each of which has its ranges in order. Spark sorts them, on disk where they are too many."""
    place = F.floor(F.col("range") * F.lit(parts) / F.lit(count)).cast("int")
    return blobs.repartitionById(parts, place).sortWithinPartitions("range")


def _runs(doc: np.ndarray, copy: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Covered windows, neighbours together."""
    order = np.lexsort((first, copy, doc))
    doc, copy, first = doc[order], copy[order], first[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (first[1:] != first[:-1] + 1)
    at = np.flatnonzero(new)
    number = np.diff(np.append(at, len(doc)))
    return _codes(doc[at], copy[at], first[at], number, np.zeros(len(at)))


def _cut(rows: DataFrame, length: int, place: int) -> DataFrame:
    """rows: row (the caller's columns, the text at `place`) and covered: array<struct<first, number>>; null: none."""
    out = with_fields(rows.sparkSession, [rows.schema["row"]], "kept_bytes binary, n_bytes long, n_removed long, n_spans long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column(0).field(place))
            covered = batch.column(1)
            for a, b in steps(offsets):
                part = covered.slice(a, b - a)
                lengths = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy()
                flat = part.flatten()
                first, number = (flat.field(j).to_numpy().astype(np.int64) for j in (0, 1))
                here = offsets[a : b + 1] - offsets[a]
                row = np.repeat(np.arange(b - a), lengths)
                edges = np.zeros(int(here[-1]) + 1, np.int64)
                np.add.at(edges, here[row] + first, 1)
                np.add.at(edges, here[row] + first + number + length - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                texts = here[:-1][np.diff(here) > 0]
                begin[texts] = gone[texts]
                size, removed, spans = np.diff(here), *(np.diff(np.append(0, np.cumsum(x))[here]) for x in (gone, begin))
                rest = data[offsets[a] : offsets[b]][~gone]
                ends = np.append(0, np.cumsum(size - removed)).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rest))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), kept, *(pa.array(x, pa.int64()) for x in (size, removed, spans))], names=["row", "kept_bytes", "n_bytes", "n_removed", "n_spans"])

    return rows.select("row", "covered").mapInArrow(frugal(run), out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """docs with kept_bytes, n_bytes, n_removed and n_spans (maximal removed runs) of each row.

    Texts are judged as they came in, not by what is left of others. Null texts count as empty
    and have nothing removed. A row with a null id neither removes nor loses anything; rows that
    repeat an id don't count against each other. Columns of docs named like the new ones are
    replaced, all others stay, whatever their names.

    Equality is that of hashes: 104 bits for contexts (k-mer and whole), 96 for windows, so two
    different strings among 10^12 are taken for one with a chance below 10^-4.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be {2 * KMER} at least")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges(entries: int | None) -> int:
        return max(-(-(entries or 0) // RANGE), parts)

    keep = docs.drop("kept_bytes", "n_bytes", "n_removed", "n_spans")
    # A null id becomes one that is never judged: a key that can be null would add a filter to one of the joins, and its shuffle.
    nobody = F.lit(-(2**63))
    doc = F.coalesce(F.col(id_col).cast("long"), nobody)
    # Where no id stands twice it names the row alone, and entries needn't carry the hash.
    alone = keep.select(doc.alias("doc")).where(F.col("doc") != nobody).groupBy("doc").count().where("count > 1").isEmpty()
    copy = F.when(doc == nobody, F.hash(text_col)).otherwise(0) if alone else F.hash(text_col)
    keyed = keep.select(doc.alias("doc"), copy.alias("copy"), F.col(text_col).alias("text"), F.struct(*(F.col(_quoted(c)) for c in keep.columns)).alias("row"))
    texts = keyed.where((F.col("doc") != nobody) & (F.octet_length("text") >= length)).select("doc", "copy", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    count = ranges(2 * (size or 0) // (length - KMER + 2))  # an anchor serves half as many windows as it could, on average
    codes = written(_judge_contexts(_by_range(_send_contexts(texts, length, count), count, parts)))
    span = F.collect_set(F.struct("first", "number"))  # rows of one id and text have the same ones
    dealt = keyed.drop("text").repartition(parts, "doc", "copy")  # one shuffle of the texts, which both joins below read
    asked = codes.where(F.col("kind") == ASKED)
    count = ranges(asked.agg(F.sum("number")).first()[0])
    spans = dealt.join(asked.groupBy("doc", "copy").agg(span.alias("asked")), ["doc", "copy"]).select("doc", "copy", "row", "asked")  # whole rows, so that the shuffle is the same
    text_at = keep.columns.index(text_col)
    windows = _judge_windows(_by_range(_send_windows(spans, length, text_at, count), count, parts))
    covered = codes.where(F.col("kind") == COVERED).select("doc", "copy", "first", "number").union(windows.select("doc", "copy", "first", "number")).groupBy("doc", "copy").agg(span.alias("covered"))
    rows = dealt.join(covered, ["doc", "copy"], "left")
    return _cut(rows, length, text_at).select("row.*", "kept_bytes", "n_bytes", "n_removed", "n_spans")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 bytes that smaller ids have."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49, 200)) AS base, unnest(list_transform(range(0, len(h) // 2 - 49, 200), lambda b: substr(h, 2 * b + 1, 498))) AS part FROM d WHERE len(h) >= 100),
w AS (SELECT doc_id, base + unnest(range(0, len(part) // 2 - 49)) AS i, unnest(list_transform(range(0, len(part) // 2 - 49), lambda j: substr(part, 2 * j + 1, 100))) AS s FROM p),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
c AS (SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS new FROM w JOIN m ON m.s = w.s WHERE doc_id > first_id),
k AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
l AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN l.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(1, CAST(n_spans AS BIGINT) + 2), lambda j: substr(h, 2 * coalesce(ends[j - 1], 0) + 1, 2 * (coalesce(starts[j], len(h) // 2) - coalesce(ends[j - 1], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id
"""
