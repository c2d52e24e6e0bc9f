"""Exact quantiles of many columns in few passes.

Each pass counts the values in a few thousand equal bins, keeps the bin that
holds the wanted position and narrows the range to it, until it holds a
single value.  Only bin counts, with the least and greatest value of each
bin, reach the driver.  The method is the same at every size, and the result
is interpolated once, between two values of the column.
"""

import math

from pyspark.sql import DataFrame, functions as F

BINS = 4096


def exact_quantiles(df: DataFrame, columns: list[str], q: float, bins: int = BINS) -> dict[str, float | None]:
    """Linear-interpolated quantile ``q`` of each column; NULLs are ignored."""
    stats = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns)
                     for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # (column, rank) -> [low, high, values below low, values in range]
    open_ranks, wanted = {}, {}
    for i, c in enumerate(columns):
        n = stats[f"n_{i}"]
        position = q * (n - 1) if n else 0.0
        wanted[c] = (n, math.floor(position), math.ceil(position), position)
        if n:
            for rank in {math.floor(position), math.ceil(position)}:
                open_ranks[c, rank] = (stats[f"lo_{i}"], stats[f"hi_{i}"], 0, n)

    found: dict[tuple[str, int], float] = {}
    while open_ranks:
        for key, (lo, hi, _, _) in list(open_ranks.items()):
            if lo == hi:
                found[key] = lo
                del open_ranks[key]
        if open_ranks:
            _narrow(df, open_ranks, bins)

    out = {}
    for c, (n, below, above, position) in wanted.items():
        if not n:
            out[c] = None
        else:
            a, b = found[c, below], found[c, above]
            out[c] = a + (b - a) * (position - below)
    return out


def approximate_quantiles(df: DataFrame, columns: list[str], q: float, rank_error: float) -> dict[str, float | None]:
    """Values of each column whose rank is within ``rank_error`` (a share of the rows) of ``q``.

    One pass with a mergeable sketch (Greenwald & Khanna, 2001), for tables
    where several exact passes cost too much.
    """
    accuracy = max(1, math.ceil(1 / rank_error))
    row = df.agg(*[F.percentile_approx(F.col(x), q, accuracy).alias(f"q_{i}") for i, x in enumerate(columns)]).first()
    return {x: row[f"q_{i}"] for i, x in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], q: float, rank_error: float | None = None) -> dict[str, float | None]:
    """Exact, or in one pass within a stated rank error."""
    return exact_quantiles(df, columns, q) if rank_error is None else approximate_quantiles(df, columns, q, rank_error)


def _narrow(df, open_ranks, bins):
    keys = list(open_ranks)
    cells = []
    for i, (c, _) in enumerate(keys):
        lo, hi, _, _ = open_ranks[keys[i]]
        half = 1.0 if hi - lo < math.inf else 2.0       # a range wider than the largest double is halved
        place = F.floor((F.col(c) / half - lo / half) / (hi / half - lo / half) * bins)
        cells.append(F.when(F.col(c).between(lo, hi), F.struct(
            F.lit(i).alias("k"), F.least(place, F.lit(bins - 1)).alias("b"), F.col(c).alias("v"))))
    counted = (df.select(F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x"))
               .groupBy("x.k", "x.b").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"),
                                          F.max("x.v").alias("hi"))
               .orderBy("k", "b").collect())            # at most keys x bins rows
    for i, key in enumerate(keys):
        below = open_ranks[key][2]
        for r in (r for r in counted if r.k == i):
            if key[1] < below + r.n:
                open_ranks[key] = (r.lo, r.hi, below, r.n)
                break
            below += r.n
