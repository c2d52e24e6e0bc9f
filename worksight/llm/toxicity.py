"""Toxicity of restored text.

A noisy channel turns words into leetspeak, spaces them out or repeats their
letters.  Tokens that look like its output are decoded: their characters
span a lattice of possible letters, and Viterbi search finds the likeliest
letters under a character trigram model of the whole corpus.  The restored
words join the text, and a logistic model over words and word beginnings
gives the score.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.materialize import materialize
from . import words as W

c = F.col
U = np.uint64

#: What a character may stand for, beside itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Separators that may stand between the letters of a word.
SEPARATORS = ".-_*'"
COST_LEET, COST_RUN, COST_DOUBLE, COST_SEPARATOR, COST_DROP = 0.7, 0.5, 6.0, 0.2, 14.0
#: Gaps between spaced-out letters, the usual one of a run and a wider one: cost of no word break there, and of one.
GAPS = {" ": (COST_SEPARATOR, 2.0), "\t": (2.0, 0.0)}
SLICE = 1 << 19          # bytes worked on at a time
PREFIXES = (4, 5, 6, 7, 8, 9, 10)

# Character classes of the language model: none, a-z, any other letter.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27
_N = 28
_IN_TOKEN = W.ALNUM.copy()
for _x in [*LEET, *SEPARATORS]:
    _IN_TOKEN[ord(_x)] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MAPPED = np.zeros(256, dtype=bool)
_MAPPED[[ord(_x) for _x in LEET]] = True
_PARTS, _WRITTEN = re.compile("[" + re.escape(SEPARATORS) + "]+"), re.compile("[a-z\x80-\U0010ffff]+")
_BLANK = ~W.NOT_SPACE
_BLANK[0x1C:0x20] = True
#: What may be a spaced-out letter; an exclamation mark only if it stands alone.
_SIGN = W.ALNUM.copy()
for _x in LEET:
    _SIGN[ord(_x)] = _x != "!"


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character triples of all texts, by class: 28 x 28 x 28 numbers at any input size."""
    def count(batches):
        total = np.zeros(_N ** 3, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in W.slices(batch.column("text"), SLICE):
                x = np.zeros(len(data) + 2 * len(bounds), dtype=np.int64)      # two boundaries between texts
                x[np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))] = _CLASS[W._LOWER[data]]
                total += np.bincount((x[:-2] * _N + x[1:-1]) * _N + x[2:], minlength=_N ** 3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(total[cells])})
    rows = docs.select(c(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "cell long, n long")
    out = np.zeros(_N ** 3)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(_N, _N, _N)


class Channel:
    """Viterbi decoder of single tokens."""

    def __init__(self, counts: np.ndarray):
        pairs, single = counts.sum(axis=2), counts.sum(axis=(0, 1))
        one = (single + 1) / (single + 1).sum()
        two = (counts.sum(axis=0) + 20 * one) / (counts.sum(axis=(0, 2))[:, None] + 20)
        self.logp = np.log((counts + 20 * two[None]) / (pairs[:, :, None] + 20)).tolist()
        self.known: dict[str, str] = {}
        self.found: dict[str, list[str]] = {}

    def decode(self, token: str) -> str:
        if len(token) > 64:         # too rarely seen again to be kept
            return self._decode(token)
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = self._decode(token)
        return self.known[token]

    def words(self, token: str) -> list[str]:
        """Words of three letters or more that a token or a run of spaced-out letters may hide and that are not in it as written.

        It is decoded as one word, with word breaks at its gaps and separators,
        and in the parts between separators, of which single letters in a row
        are one.
        """
        if token in self.found:
            return self.found[token]
        found, parts = [self.decode("".join(x for x in token if x not in GAPS))], [x for x in _PARTS.split(token) if x]
        gapped = " ".join(parts)
        if any(x in gapped for x in GAPS):
            found += self.decode(gapped).split()
        if len(parts) > 1:
            single = ""
            for x in [*parts, ""]:
                if len(x) == 1:
                    single += x
                else:
                    found += [self.decode(y) for y in (single, x) if len(y) > 2]
                    single = ""
        written = set(_WRITTEN.findall(token))
        out = [x for x in dict.fromkeys(found) if len(x) > 2 and x not in written]
        if len(token) <= 64:
            if len(self.found) > 200_000:
                self.found.clear()
            self.found[token] = out
        return out

    def _decode(self, token: str) -> str:
        logp, best = self.logp, {(0, 0, ""): (0.0, None)}       # the last two classes and the last sign seen
        bare, i = "".join(x for x in token if x not in GAPS), -1
        head, tail = len(bare) - len(bare.lstrip("!")), len(bare.rstrip("!"))       # outside, "!" may be punctuation
        for sign in token:
            if sign in GAPS:
                joined, broken = GAPS[sign]
                following = {state: (score - joined, path) for state, (score, path) in best.items()}
                for (a, b, _), (score, path) in best.items():
                    value = score + logp[a][b][0] - broken
                    if (b, 0, sign) not in following or following[b, 0, sign][0] < value:
                        following[b, 0, sign] = (value, (path, " "))
                best = following
                continue
            i += 1
            run = any(bare[j:j + 3] == sign * 3 for j in range(max(i - 2, 0), i + 1))
            if "a" <= sign <= "z":
                options = [(ord(sign) - 96, sign, 0.0)]
            elif sign in LEET:
                options = [(ord(x) - 96, x, COST_LEET) for x in LEET[sign]]
            elif ord(sign) > 127:
                options = [(27, sign, 0.0)]
            else:
                options = []
            edge = not head <= i < tail
            drop = COST_SEPARATOR if edge or sign in SEPARATORS else COST_DROP
            following: dict = {}
            for (a, b, before), (score, path) in best.items():
                lost = drop if edge or sign != before else COST_RUN if run else COST_DOUBLE
                if sign == before or not "a" <= sign <= "z":
                    moves = [((a, b, before if sign in SEPARATORS else sign), score - lost, path)]
                else:
                    moves = []
                moves += [((b, k, sign), score + logp[a][b][k] - cost, (path, letter)) for k, letter, cost in options]
                for state, value, way in moves:
                    if state not in following or following[state][0] < value:
                        following[state] = (value, way)
            best = following or best
        _, path = max(((score + logp[a][b][0], path) for (a, b, _), (score, path) in best.items()), key=lambda x: x[0])
        letters = []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))


def _suspects(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str]]:
    """Row and text of each token that may hide a word."""
    w = W.split(data, bounds, _IN_TOKEN)
    if not len(w.start):
        return
    low, letter = w.low, W.LETTERS[w.low]
    possible = letter | _MAPPED[low]
    after, before = np.append(possible[1:], False), np.append(False, possible[:-1])
    marks = (_IN_TOKEN[low] & ~letter & after) | ((_MAPPED | _DIGIT)[low] & before)
    run = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) if len(low) > 2 else np.zeros(0, dtype=bool)
    marks[:len(run)] |= run
    count = lambda x: np.concatenate(([0], np.cumsum(x)))
    letters, marked = count(possible), count(marks)
    size = letters[w.stop] - letters[w.start]
    rows = w.rows()
    for x in np.flatnonzero((marked[w.stop] > marked[w.start]) & (size >= 2)):
        yield int(rows[x]), low[w.start[x]:w.stop[x]].tobytes().decode(errors="ignore").strip(SEPARATORS)


def _blanks(low: np.ndarray) -> np.ndarray:
    """Which bytes are white space, also beyond ASCII."""
    out = _BLANK[low]
    two = np.flatnonzero((low[:-1] == 0xC2) & np.isin(low[1:], (0x85, 0xA0)))
    out[two] = out[two + 1] = True
    if len(low) > 2:
        a, b, d = low[:-2], low[1:-1], low[2:]
        three = np.flatnonzero((a >= 0xE1) & (a <= 0xE3))
        a, b, d = a[three], b[three], d[three]
        three = three[((a == 0xE1) & (b == 0x9A) & (d == 0x80)) | ((a == 0xE3) & (b == 0x80) & (d == 0x80))
                      | ((a == 0xE2) & (b == 0x80) & ((d <= 0x8A) | np.isin(d, (0xA8, 0xA9, 0xAF)))) | ((a == 0xE2) & (b == 0x81) & (d == 0x9F))]
        out[three] = out[three + 1] = out[three + 2] = True
    return out


def _spaced(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, str]]:
    """Row and text of each run of three or more single letters or signs with white space between."""
    if not len(data):
        return
    w = W.split(np.where(_blanks(data), np.uint8(32), data), bounds, W.NOT_SPACE)
    if not len(w.start):
        return
    rows, place = w.rows(), np.arange(len(w.low))
    sign = _SIGN[w.low]
    first = np.minimum.accumulate(np.where(sign, place, len(sign))[::-1])[::-1][w.start]
    last = np.maximum.accumulate(np.where(sign, place, -1))[w.stop - 1]
    alone = (w.stop - w.start == 1) & (w.low[w.start] == ord("!"))
    first, last = np.where(alone, w.start, first), np.where(alone, w.start, last)
    count = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))         # characters
    last = np.maximum(last, first - 1)
    single = (first <= last) & (first < w.stop)
    single[single] = count[last[single] + 1] - count[first[single]] == 1
    joined = np.zeros(len(single), dtype=bool)          # the next token is one letter as well, and no sign is between
    joined[:-1] = single[:-1] & single[1:] & (rows[1:] == rows[:-1]) & (last[:-1] + 1 == w.stop[:-1]) & (first[1:] == w.start[1:])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0])))).reshape(-1, 2)
    for a, b in edges[edges[:, 1] - edges[:, 0] >= 2]:
        gaps = count[w.start[a + 1:b + 1]] - count[w.stop[a:b]]
        signs = [w.low[first[x]:last[x] + 1].tobytes().decode(errors="ignore") for x in range(a, b + 1)]
        yield int(rows[a]), signs[0] + "".join((" " if g == gaps.min() else "\t") + x for g, x in zip(gaps, signs[1:], strict=True))


def restore(data: np.ndarray, bounds: np.ndarray, channel: Channel) -> tuple[np.ndarray, np.ndarray]:
    """The texts, with the restored words of each at its end."""
    extra: dict[int, list[str]] = {}
    for row, token in [*_suspects(data, bounds), *_spaced(data, bounds)]:
        words = channel.words(token)
        if words:
            extra.setdefault(row, []).extend(words)
    if not extra:
        return data, bounds
    parts, sizes = [], np.diff(bounds)
    for x in range(len(bounds) - 1):
        parts.append(data[bounds[x]:bounds[x + 1]].tobytes())
        if x in extra:
            more = (" " + " ".join(extra[x])).encode()
            parts.append(more)
            sizes[x] += len(more)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def features(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each word and word beginning (of PREFIXES bytes); only those in the sorted ``wanted``, if given."""
    w = W.split(data, bounds, W.LETTERS)
    rows, sums, size = w.rows(), w.sums(), w.stop - w.start
    near = None
    if wanted is not None:
        near = np.zeros(1 << 20, dtype=bool)
        near[wanted >> U(44)] = True
    found = []
    for k in (0, *PREFIXES):
        at = np.flatnonzero(size > k)
        h = w.hashes(sums, w.start[at] + k if k else w.stop, w.start[at])
        if not k:
            h = W.mix(h)
        if wanted is not None:
            hit = np.flatnonzero(near[h >> U(44)])
            hit = hit[wanted[np.minimum(np.searchsorted(wanted, h[hit]), len(wanted) - 1)] == h[hit]] if len(wanted) else hit[:0]
            at, h = at[hit], h[hit]
        found.append((rows[at], h))
    row, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(row) else np.zeros(0, int)
    return row[first], h[first], np.diff(np.append(first, len(row)))


def _presence(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """h, toxic texts, other texts: in how many texts (text, label) a feature occurs."""
    def count(batches):
        channel = Channel(counts)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for i, j, data, bounds in W.slices(batch.column("text"), SLICE):
                row, h, _ = features(*restore(data, bounds, channel))
                every, at = np.unique(h, return_inverse=True)
                bad = np.bincount(at, weights=label[i:j][row], minlength=len(every)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(every.view(np.int64)), "bad": pa.array(bad),
                                                  "good": pa.array(np.bincount(at, minlength=len(every)).astype(np.int64) - bad)})
    return docs.mapInArrow(count, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


@dataclass
class Model:
    counts: np.ndarray
    wanted: np.ndarray          # hashes of the features, sorted
    weights: np.ndarray
    intercept: float


def _vector(batches, model: Model):
    channel = Channel(model.counts)
    for batch in batches:
        for i, j, data, bounds in W.slices(batch.column("text"), SLICE):
            row, h, n = features(*restore(data, bounds, channel), model.wanted)
            yield batch.slice(i, j - i), row, np.searchsorted(model.wanted, h), np.log1p(n)


def fit(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = 10_000, min_texts: int = 3, least_strength: float = 4.0, penalty: float = 0.00005) -> Model:
    """The character model of all ``docs`` and the classifier of at most
    ``per_class`` training rows of each label, those with the smallest hash of
    their id.  Every feature takes part that ``min_texts`` toxic rows hold and
    whose share of toxic rows is ``least_strength`` standard errors above that
    of other rows; there is no limit on their number, the penalty shrinks
    them.  Of contradictory labels of one id the smallest counts."""
    counts = character_counts(docs, text)
    known = labels.select(c(f"`{id}`").alias("id"), c(f"`{label}`").alias("label")).where(
        train & c("label").isin(0, 1) & c("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    n = {int(x[0]): x[1] for x in known.groupBy("label").count().collect()}
    model = Model(counts, np.zeros(0, U), np.zeros(0), math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    if len(n) < 2:
        return model
    sample = [known.where(c("label") == x).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(per_class) for x in (0, 1)]
    sample = F.broadcast(sample[0].union(sample[1]))          # at most 2 * per_class ids
    source = docs.select(c(f"`{id}`").alias("id"), c(f"`{text}`").cast("string").alias("text"))
    rows = materialize(source.join(sample, "id").select("text", c("label").cast("int").alias("label"))
                       .repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxic-sample")
    size = {int(x[0]): x[1] for x in rows.groupBy("label").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return model
    # Difference of the two frequencies in standard errors; only the features that take part reach the driver.
    both = (c("bad") + c("good") + 1) / F.lit(float(bad + good + 2))
    strength = (c("bad") / F.lit(float(bad)) - c("good") / F.lit(float(good))) / F.sqrt(
        both * (1 - both) * F.lit(1 / bad + 1 / good))
    strong = _presence(rows, counts).where((c("bad") >= min_texts) & (strength > least_strength)).select("h").collect()
    model.wanted = np.sort(np.array([x.h for x in strong], dtype=np.int64).view(U))
    if not len(model.wanted):
        return model

    def vectors(batches):
        for part, row, at, value in _vector(batches, model):
            edges = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.float64()),
                                              pa.ListArray.from_arrays(edges, pa.array(at.astype(np.int32))),
                                              pa.ListArray.from_arrays(edges, pa.array(value))], ["label", "at", "value"])
    width = len(model.wanted)
    sparse = F.udf(lambda at, value: Vectors.sparse(width, at, value), VectorUDT())
    table = materialize(rows.mapInArrow(vectors, "label double, at array<int>, value array<double>"), "toxic-vectors")
    fitted = LogisticRegression(regParam=penalty, elasticNetParam=0.0, maxIter=60, standardization=False).fit(
        table.select("label", sparse("at", "value").alias("features")))
    model.weights = fitted.coefficients.toArray()
    # The sample's classes are not as frequent as in the labels.
    model.intercept = float(fitted.intercept) + math.log(n[1] / n[0]) - math.log(bad / good)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` plus score, 0 to 1.

    Null and empty texts have the score of a text without any feature.  Whole
    texts are scored.  A column named score is replaced.  Rows are independent,
    so copies have equal scores; an empty table gives an empty one.
    """
    names = [x for x in docs.columns if x != "score"]
    schema = T.StructType([docs.schema[x] for x in names] + [T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        own = sent.value
        channel, weights = Channel(own.counts), own.weights
        for batch in batches:
            out = np.full(batch.num_rows, own.intercept)
            for i, j, data, bounds in W.slices(batch.column(text), SLICE):
                row, h, n = features(*restore(data, bounds, channel), own.wanted)
                if len(row):
                    out[i:j] += np.bincount(row, weights=weights[np.searchsorted(own.wanted, h)] * np.log1p(n), minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in names] + [pa.array(1 / (1 + np.exp(-out)))], names=[*names, "score"])
    return docs.mapInArrow(apply, schema)
