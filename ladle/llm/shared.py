"""Helpers that the operators share: tables, the shared folder, Arrow text buffers and hashing."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladle.sources.scratch import discard, written

__all__ = ["bounded_batches", "bounded_sample", "discard", "frugal", "held_out", "lower", "map_batches", "mix", "quoted", "shingle_sets", "slice_hashes", "steps", "table", "text_bytes", "with_fields", "words_of", "written"]

#: Bytes of text that one vectorised step works on; longer documents are a step of their own.
STEP_BYTES = 1 << 20


#: Rows of a batch between Spark and Python, when they hold whole texts.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in smaller batches than Spark's 10,000 rows, which bounds memory on both sides.

    The session keeps the setting, as a query runs after its function has returned; only the
    registered queries and the pipeline set it, the operators leave it alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name for F.col, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def with_fields(spark: SparkSession, fields: Iterable[T.StructField], new: str) -> T.StructType:
    """The schema of fields, whatever they and what they hold are called, and of the columns of `new` (a schema as a string)."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in [*fields, *spark.createDataFrame([], new).schema]])


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, followed by the return of freed memory to the system.

    Spark keeps its Python workers between tasks, and with them what their allocators hold,
    which counts against the executor while others of its tasks run.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return out


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kept: list[str], new: str) -> DataFrame:
    """df.mapInArrow for columns of any names: run gives the columns `kept` of df, then those of `new` (a schema as a string).

    Columns are named by their places while Python has them, so run must go by places.
    """
    own = {f.name: f for f in df.schema}
    added = df.sparkSession.createDataFrame([], new).schema.fields
    schema = T.StructType([T.StructField(f"_{k}", f.dataType) for k, f in enumerate([*(own[c] for c in kept), *added])])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns(schema.names)

    placed = df.select(*(F.col(quoted(c)).alias(f"_{k}") for k, c in enumerate(df.columns)))
    out = placed.mapInArrow(frugal(named), schema)
    return out.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate([*kept, *(f.name for f in added)])))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows with at most limit bytes together, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


# --- samples and folds -----------------------------------------------------------------------


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def bounded_sample(rows: DataFrame, group: str, id_col: str, most: int) -> Column:
    """A condition that at most `most` ids of each group meet: those of the smallest id hashes.

    rows needs the two columns only. Hashes are spread evenly, so the smallest `most` lie in the
    lowest share 2 * most / count of their range but for a negligible chance; only that share is
    ranked, about 2 * most rows a group however large the groups are. Two rows a group come to
    the driver.
    """
    hashed = F.xxhash64(F.col(id_col).cast("string"))
    ids = rows.select(group, hashed.alias("hash")).where(F.col(group).isNotNull())
    low = F.lit(False)
    for row in ids.groupBy(group).agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect():
        share = min(1.0, (2 * most + 200) / row["n"])
        low = low | ((F.col(group) == F.lit(row[group])) & (F.col("hash") <= F.lit(int(-(2.0**63) + share * (2.0**64 - 2048)))))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("hash"))
    limits = ids.where(low).distinct().withColumn("rank", rank).where(F.col("rank") <= most).groupBy(group).agg(F.max("hash").alias("most")).collect()
    chosen = F.lit(False)
    for row in limits:
        chosen = chosen | ((F.col(group) == F.lit(row[group])) & (hashed <= F.lit(row["most"])))
    return chosen


# --- 64-bit hashes ---------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Longer slices are hashed by BLAKE2.
LONG_SLICE = 256
#: Masks that keep the first k bytes of a lane of 8.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number (zeros behind the end); one more entry than data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal slices wherever they stand.

    Lanes of 8 bytes are taken in one after the other, each followed by a bijection that no
    product or sum of lanes passes through, so that no structure of a text makes hashes meet;
    two different slices do with a chance of 2^-64. Slices over LONG_SLICE bytes take BLAKE2.
    """
    size = end - start
    at = lanes(data)
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _GOLD)
    here = np.flatnonzero((size > 0) & (size <= LONG_SLICE))
    done = 0
    while len(here):
        left = size[here] - done
        lane = at[start[here] + done] & _FIRST_BYTES[np.minimum(left, 8)]
        out[here] = mix(out[here] ^ (lane * np.uint64(0xD1342543DE82EF95))) + _GOLD
        done += 8
        here = here[left > 8]
    for i in np.flatnonzero(size > LONG_SLICE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each row the first word's index (one more entry at the end).

    A word is a run of bytes other than space and 0x09-0x0D; rows never share a word.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = inside[begin]
    finish = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[finish] = inside[finish]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles, A-Z as a-z.

    A row with fewer than width words (but one at least) has its whole sequence as one shingle.
    """
    start, end, first = words_of(data, offsets)
    if not len(start):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = slice_hashes(lower(data), start, end)
    n = max(len(words) - width + 1, 0)
    rolled = words[:n].copy()
    for j in range(1, width):
        rolled = mix(rolled * _GOLD + words[j : n + j])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = words[a : a + 1] ^ np.uint64(b - a)
            for j in range(a + 1, b):
                one = mix(one * _GOLD + words[j : j + 1])
            out.append(mix(one + np.uint64(width)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
