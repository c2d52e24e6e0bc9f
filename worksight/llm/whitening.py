"""Whitening of embeddings from an exact integer scatter matrix.

Entries become integers.  Shifted by the smallest entry of its dimension,
each is a non-negative number of few bits; bit p of dimension a over 64 rows
is one word.  The product sum of two dimensions is the sum over planes p and
q of ``2^(p+q)`` times the number of bits set in both, so an AND and a
popcount give it exactly.  Cross-products of all tasks are added as limbs of
30 bits, centred as integers of any size and only then divided: covariances
lose nothing to cancellation, however far the mean is from zero.

The d x d matrix (d: the dimension of the vectors, not of the table) goes to
the driver for ``eigh``.  Everything else is one pass over blocks of rows.

Vectors that are null or empty or hold null or non-finite entries are
dropped.  So are vectors of another length than most have (ties: the longer);
one matrix has one dimension.  Rows with a null or repeated id are rows like
any other; only the two named columns are read.  Entries whose integer would
leave 2^62 are set to that bound.  A deviation beyond 64 bits is null.  A
component without variance (equal vectors, or fewer vectors than dimensions)
has the whitened value 0 and takes no part in the identity error.
"""


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

c = F.col

SCALE, SHIFT = 64, 1_000_000
BOUND = 1 << 62
LIMB = 30
LIMBS = 6
ROWS = 4096         # rows packed at once; a multiple of 64
#: Eigenvalues below this share of the largest are rounding, not variance.
FLAT = 1e-13


def usable(vector: Column) -> Column:
    """Vectors with entries, all finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their dimension (0 if there are none)."""
    rows = embeddings.select(c(id_col).cast("long").alias("vec_id"), c(vector_col).cast("array<double>").alias("v")).where(usable(c("v")))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def _blocks(batches, d: int):
    """Ids and integers of consecutive rows, at most ``ROWS`` at a time."""
    for batch in batches:
        flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(-1, d)
        for at in range(0, len(flat), ROWS):
            scaled = np.clip(np.floor(flat[at:at + ROWS] * SCALE), -BOUND, BOUND - SHIFT)
            yield batch.column("vec_id").slice(at, ROWS), scaled.astype(np.int64) + SHIFT


def _limbs(value: int) -> list[int]:
    """Base-2^30 digits, least first; the last one takes the rest."""
    return [value >> (LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


_NAMES = [f"l{i}" for i in range(LIMBS)]
_LIMB_TYPES = ", ".join(f"{x} long" for x in _NAMES)


def _whole(row) -> int:
    return sum(row[x] << (LIMB * i) for i, x in enumerate(_NAMES))


def _ranges(rows: DataFrame, d: int):
    """Number of vectors, and sum, minimum and maximum of each dimension."""
    def task(batches):
        n, total = 0, np.zeros(d, object)
        low, high = np.full(d, BOUND), np.full(d, -BOUND)
        for _, x in _blocks(batches, d):
            n += len(x)
            # Two halves, so that no sum of a block leaves 64 bits.
            total += ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            digits = np.array([_limbs(v) for v in total], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.arange(d), "n": np.full(d, n), "low": low, "high": high,
                                              **{x: digits[:, i] for i, x in enumerate(_NAMES)}})

    found = rows.mapInArrow(lambda batches: task(batches), f"a long, n long, low long, high long, {_LIMB_TYPES}")
    found = found.groupBy("a").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                   *(F.sum(x).alias(x) for x in _NAMES)).orderBy("a").collect()
    return (found[0]["n"], [_whole(r) for r in found], np.array([r["low"] for r in found]), np.array([r["high"] for r in found]))


def bit_planes(y: np.ndarray, width: int) -> np.ndarray:
    """Words of each bit plane: [dimension, plane, word], rows in the bits of the words."""
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    padded[:len(y)] = y.astype(np.uint64)
    planes = [np.packbits((padded >> np.uint64(p) & np.uint64(1)).astype(np.uint8), axis=0) for p in range(width)]
    return np.ascontiguousarray(np.stack(planes).transpose(2, 0, 1)).view(np.uint64)


def add_products(planes: np.ndarray, into: np.ndarray) -> None:
    """Add AND-popcounts to ``into[p, part, a, b]`` for b >= a: bits of plane p of a met by the weighted planes of b.

    Part k holds the weights ``2^(q - 30 k)`` of planes 30 k to 30 k + 29, so that 64 bits hold the sums of 2^33 rows.
    """
    d, width, words = planes.shape
    flat = planes.reshape(d * width, words)
    weights = 1 << (np.arange(width, dtype=np.int64) % LIMB)
    for a in range(d):
        rest = flat[a * width:]
        for p in range(width):
            counts = np.bitwise_count(rest & planes[a, p]).sum(axis=1, dtype=np.int64).reshape(d - a, width) * weights
            for part in range(into.shape[1]):
                into[p, part, a, a:] += counts[:, part * LIMB:(part + 1) * LIMB].sum(axis=1)


def _scatter(rows: DataFrame, d: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Exact cross-products of the shifted dimensions, as Python integers."""
    width = max(int(h - v).bit_length() for h, v in zip(high.tolist(), low.tolist())) or 1

    def task(batches):
        into = np.zeros((width, -(-width // LIMB), d, d), np.int64)
        seen = False
        for _, x in _blocks(batches, d):
            add_products(bit_planes(x - low, width), into)
            seen = True
        if seen:
            for a in range(d):
                products = [sum(int(into[p, k, a, b]) << (p + LIMB * k) for p in range(width) for k in range(into.shape[1]))
                            for b in range(a, d)]
                digits = np.array([_limbs(v) for v in products], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"a": np.full(d - a, a), "b": np.arange(a, d),
                                                  **{x: digits[:, i] for i, x in enumerate(_NAMES)}})

    parts = rows.mapInArrow(lambda batches: task(batches), f"a long, b long, {_LIMB_TYPES}")
    out = np.zeros((d, d), object)
    for r in parts.groupBy("a", "b").agg(*(F.sum(x).alias(x) for x in _NAMES)).toLocalIterator():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = _whole(r)
    return out


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """Centred as integers, divided last: each entry is right to double precision."""
    return np.array([[(n * products[a, b] - sums[a] * sums[b]) / (n * n) for b in range(len(sums))] for a in range(len(sums))])


def fit(rows: DataFrame, d: int, components: int) -> dict:
    """Everything a row needs: counts, sums, mean, unit components and eigenvalues."""
    n, sums, low, high = _ranges(rows, d)
    shifted = [s - n * v for s, v in zip(sums, low.tolist())]
    cov = covariance(n, shifted, _scatter(rows, d, low, high))
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    e = values[order]
    largest = max(float(values.max()), 0.0)
    live = e > FLAT * largest * d
    trace = float(np.trace(cov))
    return {"n": n, "sums": sums, "base": [s // n for s in sums], "mean": np.array([(s % n) / n for s in sums]), "u": columns[:, order],
            "scale": np.where(live, 1 / np.sqrt(np.where(live, e, 1)), 0.0), "live": live,
            "explained": [float(max(v, 0.0)) / trace if trace > 0 else 0.0 for v in e]}


def _project(x: np.ndarray, model: dict) -> np.ndarray:
    """The integer part of the mean is taken off as an integer."""
    return ((x - np.array(model["base"], np.int64)) - model["mean"]) @ model["u"] * model["scale"]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
    most = max(max(abs(n * int(v) - s) for v, s in zip(edge, sums)) for edge in (x.min(axis=0), x.max(axis=0)))
    if most * most * x.shape[1] < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63 and max(map(abs, sums)) < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _identity_error(rows: DataFrame, d: int, model: dict) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity; rows are centred first."""
    k = len(model["live"])

    def task(batches):
        total, products, n = np.zeros(k), np.zeros((k, k)), 0
        for _, x in _blocks(batches, d):
            z = _project(x, model)
            total, products, n = total + z.sum(axis=0), products + z.T @ z, n + len(z)
        if n:
            yield pa.RecordBatch.from_pydict({"a": np.repeat(np.arange(k), k), "b": np.tile(np.arange(k), k),
                                              "product": products.ravel(), "total": np.repeat(total, k)})

    parts = rows.mapInArrow(lambda batches: task(batches), "a long, b long, product double, total double")
    found = parts.groupBy("a", "b").agg(F.sum("product").alias("product"), F.sum("total").alias("total")).collect()
    products, mean = np.zeros((k, k)), np.zeros(k)
    for r in found:
        products[r["a"], r["b"]], mean[r["a"]] = r["product"], r["total"] / model["n"]
    off = np.abs(products / model["n"] - np.outer(mean, mean) - np.eye(k))[np.ix_(model["live"], model["live"])]
    return float(off.max()) if off.size else 0.0


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1, by falling variance), n, deviation, whitened,
    explained, identity_error."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows, d = vectors(embeddings, id_col, vector_col)
    if not d:
        return embeddings.sparkSession.createDataFrame([], schema)
    model = fit(rows, d, min(components, d))
    error = _identity_error(rows, d, model)

    def task(batches):
        for ids, x in _blocks(batches, d):
            z = _project(x, model)
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids, "deviation": pa.array(deviations(x, model["n"], model["sums"]), pa.int64()),
                "z": pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), z.ravel())})

    wide = rows.mapInArrow(lambda batches: task(batches), "vec_id long, deviation long, z array<double>")
    explained = F.array(*(F.lit(v) for v in model["explained"]))
    return (wide.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("vec_id", (c("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, c("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
