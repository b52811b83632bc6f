"""Embedding whitening (operator 13): exact second moments from bit planes, then principal components.

Entries become integers. A block of rows is shifted to begin at zero in each dimension; then each
bit of a dimension is a plane over the rows, packed into words, and the number of bits that two
planes share, weighted by their places, adds up to the exact cross-product of two dimensions.
Blocks and tasks add up; only sums of dimensions and of pairs of dimensions reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, map_batches, quoted, table

#: Rows of a block: a plane has so many bits.
BLOCK_ROWS = 8192
#: Sums of any size are added up by parts of so many bits.
LIMB_BITS = 60
_SCALE, _SHIFT = 1024, 100_000


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their entries as floor(1024 * c) + 100,000 (int64, or Python's integers where those don't fit)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == dim)
    if not len(good) or not dim:
        return good[:0], np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(good)).flatten().cast(pa.float64())
    values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(good), dim)
    finite = np.isfinite(values).all(1)
    good, values = good[finite], values[finite]
    with np.errstate(over="ignore"):
        scaled = np.floor(values * _SCALE)
    if not np.isfinite(scaled).all():
        scaled = np.array([[int(v) * _SCALE for v in r] for r in values.tolist()], object)  # so large a double is whole
        return good, scaled + _SHIFT
    if len(scaled) and np.abs(scaled).max() >= 2.0**62:
        return good, np.array([[int(v) + _SHIFT for v in r] for r in scaled.tolist()], object)
    return good, scaled.astype(np.int64) + _SHIFT


def planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of non-negative columns: words (one row a plane), each plane's column and its weight's exponent."""
    rows = -(-len(values) // 64) * 64
    words, column, bit = [], [], []
    for j in range(values.shape[1]):
        own = values[:, j]
        for b in range(int(own.max()).bit_length()):
            bits = np.zeros(rows, bool)
            bits[: len(own)] = (own >> b) & 1
            words.append(np.packbits(bits).view(np.uint64))
            column.append(j)
            bit.append(b)
    return (np.array(words) if words else np.zeros((0, rows // 64), np.uint64)), np.array(column, int), np.array(bit, int)


def cross_products(values: np.ndarray) -> np.ndarray:
    """All sums of products of two columns of integers, as Python's integers (object)."""
    n, dim = values.shape
    low = values.min(0)
    words, column, bit = planes(values - low)
    total = np.zeros((dim, dim), object)
    # A count has as many bits as a block has rows, at most; where its weight leaves 64 bits, Python's integers take over.
    wide = len(bit) > 0 and int(bit.max()) + n.bit_length() > 62
    for k in range(len(words)):
        c = int(column[k])
        begin = int(np.searchsorted(column, c))
        shared = np.bitwise_count(words[begin:] & words[k]).sum(1, dtype=np.int64)
        shared = shared.astype(object) * np.array([1 << b for b in bit[begin:].tolist()], object) if wide else shared << bit[begin:]
        columns, first = np.unique(column[begin:], return_index=True)
        total[c, columns] += np.add.reduceat(shared, first).astype(object) * (1 << int(bit[k]))
    total = np.triu(total) + np.triu(total, 1).T
    # sum (y + m)(z + l) = sum yz + m sum z + l sum y + n m l
    sums = np.array([int(x) for x in (values - low).astype(object).sum(0)] if values.dtype == object else (values - low).sum(0).tolist(), object)
    low = np.array([int(x) for x in low], object)
    return total + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer of any size as (k, part): the sum of part * 2^(LIMB_BITS * k), the last part with the sign."""
    k = 0
    while not -(1 << LIMB_BITS) <= value < 1 << LIMB_BITS:
        yield k, value & ((1 << LIMB_BITS) - 1)
        value, k = value >> LIMB_BITS, k + 1
    yield k, value


@dataclass(frozen=True)
class Whitening:
    """n rows with sums per dimension; components (columns), falling eigenvalues of the covariance and its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def dimension(vectors: DataFrame, vector_col: str) -> int:
    """The commonest length of vectors that aren't null (of equally common ones the largest); 0 if there is none."""
    sizes = vectors.select(F.size(quoted(vector_col)).alias("d")).where("d > 0").groupBy("d").count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def moments(vectors: DataFrame, vector_col: str, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows that count, exact sums of dimensions and exact sums of products of two dimensions."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, held, rows = 0, np.zeros(dim, object), np.zeros((dim, dim), object), [], 0

        def block() -> None:
            nonlocal sums, products, held, rows
            values = np.concatenate(held) if held else np.zeros((0, dim), np.int64)
            if len(values):
                sums = sums + np.array([int(x) for x in values.astype(object).sum(0)], object)
                products = products + cross_products(values)
            held, rows = [], 0

        for batch in batches:
            _, values = integers(batch.column(0), dim)
            n += len(values)
            for a in range(0, len(values), BLOCK_ROWS):
                held.append(values[a : a + BLOCK_ROWS])
                rows += len(held[-1])
                if rows >= BLOCK_ROWS:
                    block()
        block()
        if n:
            i, j = np.triu_indices(dim)
            sums_of = [(-1, -1, n)] + [(-1, k, v) for k, v in enumerate(sums.tolist())] + list(zip(i.tolist(), j.tolist(), products[i, j].tolist()))
            rows = [(a, b, *x) for a, b, v in sums_of for x in limbs(v)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "limb", "part"])

    parts = vectors.select(quoted(vector_col)).mapInArrow(gather, "i int, j int, limb int, part long")
    cells: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("total")).collect():
        cells[r["i"], r["j"]] = cells.get((r["i"], r["j"]), 0) + (int(r["total"]) << LIMB_BITS * r["limb"])
    products = [[cells.get((min(i, j), max(i, j)), 0) for j in range(dim)] for i in range(dim)]
    return cells.get((-1, -1), 0), [cells.get((-1, j), 0) for j in range(dim)], products


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening:
    """Components of all vectors without null or non-finite entries.

    Vectors of another length than the commonest don't count. Moments and their centring are
    exact: n^2 times the covariance is n * (sum of products) - (product of sums), in integers;
    only then come doubles. A few rows for each pair of dimensions reach the driver. Entries may
    be so large that their covariance passes the range of doubles; that raises a ValueError.
    """
    dim = dimension(vectors, vector_col)
    n, sums, products = moments(vectors, vector_col, dim) if dim else (0, [], [])
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    try:
        covariance = np.array([[c / (n * n) for c in row] for row in centred])
    except OverflowError as error:
        raise ValueError("the covariance is beyond the range of doubles") from error
    values, components = np.linalg.eigh(covariance)
    trace = sum(centred[i][i] for i in range(dim)) / (n * n)
    return Whitening(n, sums, components[:, ::-1], np.maximum(values[::-1], 0.0), trace)


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apply(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """vectors that count, without vector_col but with deviation and whitened (an array of `most` components at most).

    whitened is the centred integer vector projected on a component, over the root of its
    eigenvalue; it is 0 where that is 0 (less than 1e-12 of the trace). deviation, n^2 times the
    square of the distance from the mean, is exact; it is null where it passes 64 bits. Columns
    of vectors named like the new ones are replaced, all others stay; repeated rows stay.
    """
    keep = vectors.drop("deviation", "whitened")
    names, rest = keep.columns, [c for c in keep.columns if c != vector_col]
    at, others = names.index(vector_col), [k for k, c in enumerate(names) if c != vector_col]
    k = min(most, len(model.values))
    dim, n, sums = len(model.sums), model.n, model.sums
    root = np.sqrt(model.values[:k])
    scaled = model.components[:, :k] * np.where(model.values[:k] > 1e-12 * model.trace, 1 / np.where(root > 0, root, 1), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = integers(batch.column(at), dim)
            most_x = int(np.abs(x).max()) if x.size else 0
            if n * most_x + max(map(abs, sums), default=0) < 2**62 and x.dtype != object:
                centred = x * n - np.array(sums, np.int64)
            else:
                centred = x.astype(object) * n - np.array(sums, object)
            high = int(np.abs(centred).max()) if centred.size else 0
            if dim * high * high < 2**63:
                deviation = (centred.astype(np.int64) ** 2).sum(1).tolist()
            else:
                deviation = [d if d < 2**63 else None for d in (centred.astype(object) ** 2).sum(1)]
            # The quotient is rounded once, whatever the size of n * x - S.
            white = (centred / n if centred.dtype != object else np.array([[v / n for v in r] for r in centred.tolist()], float).reshape(len(x), dim)) @ scaled
            kept = batch.take(pa.array(good)) if len(good) < batch.num_rows else batch
            yield pa.RecordBatch.from_arrays([*(kept.columns[i] for i in others), pa.array(deviation, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=[*rest, "deviation", "whitened"])

    if not n:
        return keep.drop(vector_col).withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}).where("false")
    return map_batches(keep, run, rest, "deviation long, whitened array<double>")


def identity_error(white: DataFrame, size: int, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of arrays of that size, minus the identity (0 for no rows).

    Every task centres its own rows before it multiplies; tasks' means and sums of products are
    then merged about the common mean.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            m = batch.num_rows
            if m:
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(m, size)
                own = w.mean(0)
                gap, share = own - mean, m / (n + m)
                scatter += (w - own).T @ (w - own) + np.outer(gap, gap) * n * share
                mean, n = mean + gap * share, n + m
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "mean": pa.array([mean.tolist()]), "scatter": pa.array([scatter.ravel().tolist()])})

    if not size:
        return 0.0
    parts = white.select(column).mapInArrow(gather, "n long, mean array<double>, scatter array<double>")

    def total(weight, name: str, places: int):
        return [F.sum(weight * F.get(name, F.lit(k))).alias(f"{name}_{k}") for k in range(places)]

    first = parts.agg(F.sum("n").alias("n"), *total(F.col("n"), "mean", size)).first()
    if not first["n"]:
        return 0.0
    mean = [first[f"mean_{k}"] / first["n"] for k in range(size)]
    between = [F.sum(F.col("n") * (F.get("mean", F.lit(i)) - mean[i]) * (F.get("mean", F.lit(j)) - mean[j])).alias(f"b_{i}_{j}") for i in range(size) for j in range(size)]
    second = parts.agg(*total(F.lit(1.0), "scatter", size * size), *between).first()
    covariance = np.array([[(second[f"scatter_{i * size + j}"] + second[f"b_{i}_{j}"]) / first["n"] for j in range(size)] for i in range(size)])
    return float(np.abs(covariance - np.eye(size)).max())


def whitened(vectors: DataFrame, vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each vector that counts and each component: its columns but vector_col, and component, n, deviation, whitened, explained and identity_error.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those of
    another length than the commonest. Repeated rows stay and count each. An empty table gives
    no rows. Columns of vectors named like the new ones are replaced.
    """
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    keep = vectors.select(*(F.col(quoted(c)) for c in vectors.columns if c == vector_col or c.lower() not in new))
    model = fit(keep, vector_col)
    rows = apply(keep, model, vector_col, most)
    size = min(most, len(model.values))
    error = identity_error(rows, size)
    explained = (model.values[:size] / model.trace if model.trace else np.zeros(size)).tolist()
    place = _free(keep, "_place")
    names = [F.col(quoted(c)) for c in keep.columns if c != vector_col]
    long = rows.select(*names, "deviation", F.posexplode("whitened").alias(place, "whitened"))
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return long.select(*names, (F.col(place) + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col(place)).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector (null vectors and such with null or non-finite entries are dropped, a null id stays)."""
    bounded_batches(spark)
    found = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
