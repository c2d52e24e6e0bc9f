"""Token counts of the sections of a document.

The whole document is encoded once.  Tokens of a byte-level vocabulary cover
its bytes without gap or overlap, so their spans follow from the lengths of
the tokens.  An interval join gives each token to the section it lies in;
one that touches several goes to one of them by an explicit rule.
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as W

ADDED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_sections", T.LongType()),
                      T.StructField("n_crossing", T.LongType()), T.StructField("n_outside", T.LongType()),
                      T.StructField("section_tokens", T.ArrayType(T.LongType()))])
RULES = ("largest", "first", "last")
_models: dict[str, tuple] = {}


def load(path: str, pattern: str):
    """The encoder of a rank file and the byte length of each token."""
    if path not in _models:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        lengths[list(ranks.values())] = [len(x) for x in ranks]
        _models[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _models[path]


def line_spans(data: np.ndarray) -> np.ndarray:
    """First byte and end of each line, line feeds left out; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 10)
    return np.stack([np.concatenate(([0], feeds + 1)), np.append(feeds, len(data))], axis=1)


def attribute(stops: np.ndarray, spans: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many touch several.  ``stops``: ends of
    the tokens; ``spans``: sorted, without overlap.  ``first`` and ``last`` give
    a crossing token to the first or last section that it touches, ``largest``
    to that of which it covers most, the first of equals."""
    counts = np.zeros(len(spans), dtype=np.int64)
    own = np.flatnonzero(spans[:, 1] > spans[:, 0])
    if not len(stops) or not len(own):
        return counts, 0
    begin, end = spans[own, 0], spans[own, 1]
    starts = np.concatenate(([0], stops[:-1]))
    low, high = np.searchsorted(end, starts, side="right"), np.searchsorted(begin, stops, side="left") - 1
    section = low.copy()
    crossing = np.flatnonzero(high > low)
    if rule == "last":
        section[crossing] = high[crossing]
    elif rule == "largest":
        for x in crossing:
            at = np.arange(low[x], high[x] + 1)
            section[x] = at[np.argmax(np.minimum(end[at], stops[x]) - np.maximum(begin[at], starts[x]))]
    np.add.at(counts, own[section[low <= high]], 1)
    return counts, len(crossing)


def token_counts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", sections: str | None = None,
                 rule: str = "largest") -> DataFrame:
    """The columns of ``docs`` plus n_tokens, n_sections, n_crossing,
    n_outside (tokens in no section) and section_tokens.

    ``sections`` names a column of (start, stop) character spans, sorted and
    without overlap; without it the lines of the text are the sections.  A
    null list has no sections.  Null texts count as empty.  ``ranks`` and
    ``pattern``: a byte-level vocabulary, whose file all executors have.
    Columns with the name of an added one are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    names = [x for x in docs.columns if x not in ADDED.names]
    schema = T.StructType([docs.schema[x] for x in names] + ADDED.fields)

    def count(batches):
        model, lengths = load(ranks, pattern)
        for batch in batches:
            given = batch.column(sections).to_pylist() if sections else None
            out = []
            for x, value in enumerate(batch.column(text)):
                body = value.as_py() or ""
                data = np.frombuffer(body.encode(), np.uint8)
                stops = np.cumsum(lengths[model.encode_to_numpy(body, disallowed_special=())])
                if given is None:
                    spans = line_spans(data)
                else:
                    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    spans = at[np.minimum(np.array([tuple(s.values())[:2] for s in given[x] or []], dtype=np.int64).reshape(-1, 2), len(at) - 1)]
                counts, crossing = attribute(stops, spans, rule)
                out.append((len(stops), len(spans), crossing, len(stops) - int(counts.sum()), counts))
            arrays = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
            arrays.append(pa.array([o[4] for o in out], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + arrays, names=names + ADDED.names)
    return docs.mapInArrow(count, schema)
