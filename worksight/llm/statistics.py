"""Statistics of whole texts, one pass, no Python object per word."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import words as W

NAMES = ("n_bytes", "n_words", "n_lines", "word_bytes", "upper", "digits", "symbols", "stops", "pipes", "not_ascii",
         "blank", "symbol_words", "upper_words", "distinct_words", "repeated_neighbours", "repeated_triples",
         "words_per_line", "longest_word")
_UPPER, _DIGIT, _SYMBOL, _STOP, _BLANK = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP[[33, 46, 63]] = True
_SYMBOL[[33, 44, 46, 63, 34, 39, 45, 124]] = False
_SYMBOL[33] = True
_BLANK[[32, *range(9, 14)]] = True


def of_slice(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    n = len(bounds) - 1
    w = W.split(data, bounds, W.NOT_SPACE)
    rows, counts = w.rows(), w.counts
    words, size = np.maximum(counts, 1), np.maximum(np.diff(bounds), 1)

    def share(table):
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / size, sums

    def per_word(marks):
        return np.bincount(rows, weights=marks, minlength=n) / words

    upper, upper_sums = share(_UPPER)
    symbols, symbol_sums = share(_SYMBOL)
    line = np.zeros(256, dtype=bool)
    line[10] = True
    lines = share(line)[0] * size + 1
    pipe = np.zeros(256, dtype=bool)
    pipe[124] = True
    not_ascii = np.arange(256) >= 128
    length = w.stop - w.start
    h = w.hashes()
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    row, key = W.shingle_sets(w, 1)
    triples = np.maximum(counts - 2, 1)
    distinct = np.bincount(row, minlength=n)
    starts = W.window_starts(w.first, 3, len(h))
    three = (rows[starts].astype(W.U) << W.U(52)) | (W.window_hashes(h, 3)[starts] >> W.U(12))
    own = np.bincount((np.unique(three) >> W.U(52)).astype(np.int64), minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    return {
        "n_bytes": np.diff(bounds).astype(float), "n_words": counts.astype(float), "n_lines": lines,
        "word_bytes": np.bincount(rows, weights=length, minlength=n) / words, "upper": upper, "digits": share(_DIGIT)[0],
        "symbols": symbols, "stops": share(_STOP)[0], "pipes": share(pipe)[0], "not_ascii": share(not_ascii)[0],
        "blank": share(_BLANK)[0], "symbol_words": per_word((symbol_sums[w.stop] - symbol_sums[w.start]) > 0),
        "upper_words": per_word((upper_sums[w.stop] - upper_sums[w.start]) > 1), "distinct_words": distinct / words,
        "repeated_neighbours": np.bincount(rows, weights=same, minlength=n) / words,
        "repeated_triples": np.where(counts >= 3, 1 - own / triples, 0.0), "words_per_line": counts / lines,
        "longest_word": longest}


def add_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) plus the statistics; null and empty texts have zeros and one line."""
    names = [x for x in (docs.columns if keep is None else keep) if x not in NAMES]
    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField(x, T.DoubleType()) for x in NAMES])

    def measure(batches):
        for batch in batches:
            parts = [of_slice(data, bounds) for _, _, data, bounds in W.slices(batch.column(text))]
            arrays = [pa.array(np.concatenate([p[x] for p in parts]) if parts else [], pa.float64()) for x in NAMES]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + arrays, names=[*names, *NAMES])
    return docs.mapInArrow(measure, schema)
