"""Nearest neighbours by largest inner product, as a block matrix join.

Queries and candidates are dealt into blocks; every tile of a query block
and a candidate block is one task's work.  In a tile both sides are
quantised to int8 with one scale per vector, and the product of the two
matrices gives all scores up to an error that the residues bound.  The mean
of a tile's candidates is taken off before they are quantised, since its
product with a query is one number; so an offset that all vectors share does
not coarsen the scale.  Pairs that may still be among the k best are computed
again from the original vectors in double precision, in slices of a bounded
size.  A heap per query merges the tiles.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import materialize

c = F.col

#: Numbers of the vectors of the pairs that are multiplied at once.
SLICE = 1 << 21


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of at most 127 in size, their scale, the norm of the residue and that of the vector."""
    scale = np.maximum(np.abs(x).max(axis=1), np.finfo(float).tiny) / 127      # a vector on the mean is all zero
    whole = np.rint(x / scale[:, None])
    return whole, scale, np.linalg.norm(x - whole * scale[:, None], axis=1), np.linalg.norm(x, axis=1)


def best_of_tile(queries: np.ndarray, found: np.ndarray, allowed: np.ndarray, k: int):
    """Query index, candidate index and score of all pairs that can be among a query's k best in this tile."""
    mean = found.mean(axis=0)
    qi, qs, qr, qn = _quantise(queries)
    vi, vs, vr, vn = _quantise(found - mean)
    base, largest = queries @ mean, np.linalg.norm(found, axis=1)
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64    # whole products stay exact
    about = (qi.astype(exact) @ vi.astype(exact).T).astype(np.float64) * qs[:, None] * vs[None, :] + base[:, None]
    # q.v - about = residue(q).w + (q - residue(q)).residue(w) with w = v - mean, by Cauchy-Schwarz, plus rounding
    error = (qr[:, None] * vn[None, :] + (qn + qr)[:, None] * vr[None, :]
             + 1e-9 * qn[:, None] * (largest + np.linalg.norm(mean))[None, :])
    low = np.where(allowed, about - error, -np.inf)
    least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    q, v = np.nonzero(allowed & (about + error >= least[:, None]))
    score, step = np.empty(len(q)), max(1, SLICE // queries.shape[1])
    for i in range(0, len(q), step):
        score[i:i + step] = np.cumsum(queries[q[i:i + step]] * found[v[i:i + step]], axis=1)[:, -1]
    return q, v, score


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding",
            query_block: int = 1024, block: int = 4096) -> DataFrame:
    """query_id, rank, id, score: the ``k`` best candidates of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all other rows, copies and rows with the same id included.  Ties go to the
    smaller id.  Vectors that are null, empty, zero or hold null or non-finite
    parts take no part, as do rows without an id; vectors of different lengths
    do not meet.  With fewer than ``k`` candidates all are returned.  The
    numbers of blocks follow from the row counts, so a tile has about
    ``query_block`` x ``block`` pairs at any input size.
    """
    # Written once with its number: both sides of the join must agree on it.
    rows = materialize(vectors.select(c(f"`{id}`").cast("long").alias("id"), c(f"`{vector}`").alias("x"),
                                      F.monotonically_increasing_id().alias("row")), "vectors")
    rows = rows.withColumn("x", F.transform("x", lambda x: x.cast("double"))).where("id is not null and size(x) > 0 and exists(x, e -> e != 0) and forall(x, e -> e is not null and "
                      "not isnan(e) and abs(e) < double('infinity'))").withColumn("dim", F.size("x"))
    is_query = c("id") % every == 0
    n, m = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    across, down = max(1, -(-n // block)), max(1, -(-m // query_block))
    # Row numbers deal out copies of one id evenly, and the same way again after a loss.
    found = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(across)).alias("tc"),
                        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("tr"))
    asked = rows.where(is_query).select("*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(down)).cast("int").alias("tr"),
                                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("tc"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
            for i in range(0, len(a), 256):
                own = left.iloc[i:i + 256]
                q, v, score = best_of_tile(a[i:i + 256], b, own["row"].to_numpy()[:, None] != right["row"].to_numpy()[None, :], k)
                ids = right["id"].to_numpy()[v]
                order = np.lexsort((ids, -score, q))
                q, ids, score = q[order], ids[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                keep = place < k
                out.append(pd.DataFrame({"row": own["row"].to_numpy()[q[keep]], "query_id": own["id"].to_numpy()[q[keep]],
                                         "id": ids[keep], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "query_id": [], "id": [], "score": []})

    tiles = asked.groupBy("dim", "tr", "tc").cogroup(found.groupBy("dim", "tr", "tc")).applyInPandas(
        tile, "row long, query_id long, id long, score double")

    def merge(batches):
        heaps: dict[int, list] = {}
        owner: dict[int, int] = {}
        for batch in batches:
            for row, query, i, score in zip(*(batch[x].to_numpy() for x in ("row", "query_id", "id", "score")), strict=True):
                heap = heaps.setdefault(row, [])
                owner[row] = query
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -i))
            if len(heaps) > 50_000:     # sorted by row, so all but the last are complete
                last = heaps.pop(row)
                yield _listed(heaps, owner)
                heaps = {row: last}
        yield _listed(heaps, owner)

    def _listed(heaps, owner):
        out = [(owner[row], rank, -i, score) for row, heap in heaps.items()
               for rank, (score, i) in enumerate(sorted(heap, reverse=True), 1)]
        return pd.DataFrame(out, columns=["query_id", "rank", id, "score"])

    return tiles.repartition("row").sortWithinPartitions("row").mapInPandas(
        merge, f"query_id long, rank int, `{id}` long, score double")
