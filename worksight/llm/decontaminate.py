"""Benchmark decontamination: broadcast windows of the benchmark, scan all token windows of the documents.

A window is ``k`` consecutive words of an item; an item with fewer words,
but not none, is one window.  Windows go to the tasks as a hash set, in
parts of a bounded size: a benchmark beyond one part is scanned in several
passes.  A hash hit counts after the words themselves were compared.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import materialize
from . import words as W

PART_BYTES = 32 << 20
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                      T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
                      T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
_PLAIN = np.where(W.ALNUM, np.arange(256), 0x20).astype(np.uint8)


def windows(benchmark: DataFrame, k: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, length, words: each window of each item, its words joined by a blank."""
    def find(batches):
        for batch in batches:
            out = []
            for i, j, data, bounds in W.slices(batch.column("text")):
                w = W.split(data, bounds, W.ALNUM)
                ids = batch.column("item").slice(i, j - i).to_pylist()
                for name, a, b in zip(ids, w.first[:-1], w.first[1:], strict=True):
                    n = min(k, b - a)
                    every = [w.low[w.start[x]:w.stop[x]].tobytes() for x in range(a, b)]
                    out += [(name, int(n), b" ".join(every[x:x + n]).decode()) for x in range(b - a - n + 1) if n]
            yield pa.RecordBatch.from_pydict({"item": pa.array([x[0] for x in out], pa.string()),
                                              "length": pa.array([x[1] for x in out], pa.int32()),
                                              "words": pa.array([x[2] for x in out], pa.string())})
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"),
                            F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(find, "item string, length int, words string").distinct()


class Grams:
    """One part of the windows, as tasks use it."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        lengths = defaultdict(set)
        for item, length, words in rows:
            key = words.encode()
            self.items[key].append(item)
            lengths[length].add(key)
        self.filters = []
        for length, keys in sorted(lengths.items()):
            data = np.frombuffer(b" ".join(keys), np.uint8)
            h = W.split(data, np.array([0, len(data)]), W.ALNUM).hashes()
            hashes = np.unique(W.window_hashes(h, length)[::length])
            near = np.zeros(1 << 20, dtype=bool)
            near[hashes >> W.U(44)] = True
            self.filters.append((length, hashes, near))

    def scan(self, w: W.Words, mask: np.ndarray, found: dict[int, set[str]]) -> None:
        """Marks hit words in ``mask`` and adds the items of each row to ``found``."""
        h, rows = w.hashes(), w.rows()
        for length, hashes, near in self.filters:
            if len(h) < length:
                continue
            g = W.window_hashes(h, length)
            at = np.flatnonzero(near[g >> W.U(44)])
            at = at[hashes[np.minimum(np.searchsorted(hashes, g[at]), len(hashes) - 1)] == g[at]]
            for i in at[rows[at] == rows[at + length - 1]]:
                key = b" ".join(_PLAIN[w.low[w.start[i]:w.stop[i + length - 1]]].tobytes().split())
                if key in self.items:
                    mask[i:i + length] = True
                    found[int(rows[i])].update(self.items[key])


def _runs(mask: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


def _pass(docs: DataFrame, text: str, rows: list, again: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    names = [x for x in docs.columns if x not in ADDED.names]
    schema = T.StructType([docs.schema[x] for x in names] + ADDED.fields)
    grams: list[Grams] = []

    def scan(batches):
        if not grams:
            grams.append(Grams(sent.value))
        for batch in batches:
            n_words, n_hit, hits, items = [], [], [], []
            for i, j, data, bounds in W.slices(batch.column(text)):
                w = W.split(data, bounds, W.ALNUM)
                mask, found = np.zeros(len(w.start), dtype=bool), defaultdict(set)
                if again:
                    for x, (spans, names_before) in enumerate(zip(batch.column("hits").slice(i, j - i).to_pylist(),
                                                                  batch.column("items").slice(i, j - i).to_pylist(), strict=True)):
                        for a, b in spans:
                            mask[w.first[x] + a:w.first[x] + b] = True
                        if names_before:
                            found[x].update(names_before)
                grams[0].scan(w, mask, found)
                sums = np.concatenate(([0], np.cumsum(mask)))
                n_words.append(w.counts)
                n_hit.append(sums[w.first[1:]] - sums[w.first[:-1]])
                hits += [_runs(mask[w.first[x]:w.first[x + 1]]) if x in found else [] for x in range(j - i)]
                items += [sorted(found[x]) if x in found else [] for x in range(j - i)]
            whole = lambda x: np.concatenate(x).astype(np.int64) if x else []
            arrays = [pa.array(x, t) for x, t in zip((whole(n_words), whole(n_hit), hits, items), _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + arrays, names=names + ADDED.names)
    return docs.mapInArrow(scan, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 10, text: str = "text", item: str = "item_id",
                  item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The columns of ``docs`` plus n_words, n_hit, hits and items.

    ``hits`` are the spans of hit words, from the first on and up to, not
    including, the second; ``items`` the sorted ids of the items with a window
    in the text.  Null and empty texts have no words; an empty benchmark hits
    nothing; repeated items and windows count once; a null item id is called
    "null".  Columns of ``docs`` with the name of an added one are replaced.
    ``part_bytes`` bounds what is broadcast at a time, whatever the size of the
    benchmark; texts are read once for each part.
    """
    grams = materialize(windows(benchmark, k, item, item_text), "grams")
    size = grams.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 64)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    docs = docs.drop(*ADDED.names)
    for i in count():
        own = grams.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == i).collect()
        docs = _pass(docs, text, [tuple(x) for x in own], again=i > 0)
        if i + 1 == parts:
            return docs
        docs = materialize(docs, "scanned")


def without_hits(scanned: DataFrame, text: str = "text") -> DataFrame:
    """``text`` without its hit words and what stands between them and the next word."""
    def cut(batches):
        for batch in batches:
            out = batch.column(text).to_pylist()
            for x, spans in enumerate(batch.column("hits").to_pylist()):
                if spans:
                    data = np.frombuffer(out[x].encode(), np.uint8)
                    w = W.split(data, np.array([0, len(data)]), W.ALNUM)
                    edge, kept, at = np.append(w.start, len(data)), [], 0
                    for a, b in spans:
                        kept.append(data[at:w.start[a]].tobytes())
                        at = edge[b]
                    out[x] = b"".join([*kept, data[at:].tobytes()]).decode()
            yield batch.set_column(batch.schema.get_field_index(text), text, pa.array(out, batch.schema.field(text).type))
    return scanned.mapInArrow(cut, scanned.schema)
