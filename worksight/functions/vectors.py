"""Numpy helpers for sparse vectors, used inside tasks."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAIRS_AT_ONCE = 500


def parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each list starts and ends."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def dots(ids_1: pa.ListArray, weights_1: pa.ListArray, ids_2: pa.ListArray, weights_2: pa.ListArray) -> np.ndarray:
    """Dot product of each pair of sparse vectors; ids are ascending inside a vector."""
    (a, at), (u, _), (b, bt), (v, _) = parts(ids_1), parts(weights_1), parts(ids_2), parts(weights_2)
    out = np.zeros(len(ids_1))
    for i in range(len(out)):
        one, two = a[at[i]:at[i + 1]], b[bt[i]:bt[i + 1]]
        if not len(one) or not len(two):
            continue
        place = np.minimum(np.searchsorted(one, two), len(one) - 1)
        both = one[place] == two
        out[i] = u[at[i]:at[i + 1]][place[both]] @ v[bt[i]:bt[i + 1]][both]
    return out


def score_pairs(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
    """Cosine of each pair ``(group_1, group_2)`` from the unit vectors ``(group, ids, w)``, one row for each group."""
    vectors = vectors.combine_chunks()
    known = vectors.column("group")
    places = [pc.index_in(pairs.column(f"group_{i}"), value_set=known) for i in (1, 2)]
    sides = [vectors.column(x).combine_chunks() for x in ("ids", "w")]
    sides = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in sides]
    found = [np.zeros(0)]
    for at in range(0, pairs.num_rows, PAIRS_AT_ONCE):      # so few copies of the vectors are made at a time
        one, two = (p.slice(at, PAIRS_AT_ONCE).combine_chunks() for p in places)
        found.append(dots(*(x.take(p) for p in (one, two) for x in sides)))
    return pa.table({"group_1": pairs.column("group_1"), "group_2": pairs.column("group_2"), "cosine": np.concatenate(found)})
