"""Near-duplicates by fast similarity sketching.

A sketch has ``bands * rows`` coordinates.  In each round every shingle is
hashed into one coordinate, which keeps the smallest (round, hash); after as
many rounds as coordinates, the ones still empty are filled by a round in
which all shingles go to that coordinate.  So every coordinate is filled,
and a text needs about n + t log t hashes instead of n * t.  Bands of the
sketch are the buckets; pairs from buckets are confirmed on full sets.

Texts with equal sets are one class from the start.  A bucket is not
expanded into pairs: its members are compared with one of them, links are
joined to components, and only members of different components are compared
again; what is open in the end is paired through its rarest shingles.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.materialize import materialize
from ..plans.skew import salt_of, salts
from . import words as W
from .components import components

c = F.col
U = np.uint64
_EMPTY = U((1 << 64) - 1)
_LOW = U((1 << 52) - 1)
BLOCKS = 128
PAIRED_ROWS_PER_TASK = 2_000
_SEEDS = W.mix(np.arange(1, 4097, dtype=U) * U(0xA0761D6478BD642F))


def sketch(row: np.ndarray, h: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t coordinates; ``row`` and ``h``: the row and hash of each set member.  Rows without members stay empty."""
    out = np.full(n * t, _EMPTY, dtype=U)

    def put(row, h, rounds):
        g = W.mix(h[None, :] ^ _SEEDS[rounds][:, None])
        at = ((g >> U(32)) * U(t)) >> U(32)
        at = at.astype(np.int64) + row[None, :] * t
        np.minimum.at(out, at.ravel(), ((rounds.astype(U) << U(52))[:, None] | (g & _LOW)).ravel())

    done = 0
    while done < t and len(row):
        block = min(t - done, max(1, 16_384 // len(row)))     # few members: several rounds at a time
        put(row, h, np.arange(done, done + block))
        done += block
        waiting = (out.reshape(n, t) == _EMPTY).any(axis=1)[row]
        row, h = row[waiting], h[waiting]
    if len(row):
        first, last = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), side="right")
        at, place = np.nonzero(out.reshape(n, t) == _EMPTY)
        at, place = at[last[at] > first[at]], place[last[at] > first[at]]
        size = last[at] - first[at]
        member = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        place, at = np.repeat(place, size), np.repeat(at, size)
        g = W.mix(h[member] ^ _SEEDS[t + place])
        np.minimum.at(out, at * t + place, ((t + place).astype(U) << U(52)) | (g & _LOW))
    return out.reshape(n, t)


def signatures(docs: DataFrame, id: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, mark (hash of the text), n_shingles, cls (hash of the set, null if empty) and the bands."""
    source = docs.select(c(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"),
                         c(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for i, j, data, bounds in W.slices(batch.column("text"), size=1 << 20):
                n = j - i
                row, h = W.shingle_sets(W.split(data, bounds, W.NOT_SPACE), k)
                size = np.bincount(row, minlength=n)
                full, first = np.unique(row, return_index=True)
                cls = np.zeros(n, dtype=U)
                if len(full):
                    sums = [np.add.reduceat(W.mix(h ^ s), first) for s in _SEEDS[-2:]]
                    cls[full] = W.mix(sums[0] + W.mix(sums[1] + size[full].astype(U)))
                s = W.mix(sketch(row, h, n, bands * rows)).reshape(n, bands, rows) * W._PLACE[:rows]
                keys = W.mix(s.sum(axis=2, dtype=U) ^ _SEEDS[:bands]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32),
                                                 keys[size > 0].ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, n), batch.column("mark").slice(i, n), pa.array(size.astype(np.int64)),
                     pa.array(cls.view(np.int64), mask=size == 0), lists], ["id", "mark", "n_shingles", "cls", "bands"])
    return source.mapInArrow(sign, f"id {kind}, mark long, n_shingles long, cls long, bands array<long>")


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """cls, h: one row for each distinct shingle of a class."""
    def explode(batches):
        for batch in batches:
            for i, j, data, bounds in W.slices(batch.column("text")):
                row, h = W.shingle_sets(W.split(data, bounds, W.NOT_SPACE), k)
                yield pa.RecordBatch.from_pydict({"cls": batch.column("cls").slice(i, j - i).take(pa.array(row)),
                                                  "h": pa.array(h.astype(np.int64))})
    return texts.select("cls", "text").mapInArrow(explode, "cls long, h long")


def profiles(texts: DataFrame, k: int) -> DataFrame:
    """cls, own, blocks: how many shingles of a class no other class has, and the others by block of the hash.

    Own shingles are in no intersection, and two classes share at most the
    smaller count of each block.  So the profiles bound a pair's similarity
    from above, closely so for copies that were changed in different places.
    """
    def count(batches):
        for batch in batches:
            for i, j, data, bounds in W.slices(batch.column("text")):
                row, h = W.shingle_sets(W.split(data, bounds, W.NOT_SPACE), k)
                counts = np.bincount(row * BLOCKS + (h % U(BLOCKS)).astype(np.int64), minlength=(j - i) * BLOCKS)
                own = batch.column("own").slice(i, j - i)
                lengths = np.array([len(x) if x.is_valid else 0 for x in own], dtype=np.int64)
                counts -= np.bincount(np.repeat(np.arange(j - i), lengths) * BLOCKS
                                      + own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % BLOCKS,
                                      minlength=(j - i) * BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").slice(i, j - i), pa.array(lengths),
                     pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * BLOCKS, BLOCKS, dtype=np.int32), counts.astype(np.int32))],
                    ["cls", "own", "blocks"])
    once = shingle_rows(texts, k).groupBy("h").agg(F.count("*").alias("m"), F.min("cls").alias("cls")).where("m = 1")
    own = once.groupBy("cls").agg(F.collect_list("h").alias("own"))
    return texts.join(own, "cls", "left").select("cls", "text", "own").mapInArrow(count, "cls long, own long, blocks array<int>")


def rare_pairs(rest: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different labels that may be similar enough, by an exact prefix filter.

    ``rest`` has cls, label and size (number of shingles), one row for each
    class.  Shingles are ordered by the number of classes that hold them; two
    similar sets share one of the rarest ``size - ceil(percent * size / 100) + 1``
    of each.  Only these are joined, and a match counts only if what follows
    it in both sets can still reach the threshold.  Shingles that only one
    class holds come first and are never joined, so texts that share a
    template, but differ in more than the threshold allows, meet nobody.
    """
    listed = materialize(shingle_rows(texts.join(rest.select("cls"), "cls", "left_semi"), k), "open-shingles")
    held = listed.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    own = Window.partitionBy("cls")
    # Places count from the end: how many shingles of the set follow, this one included.
    placed = (listed.join(held, "h").select("cls", "h", F.row_number().over(own.orderBy(c("m").desc(), c("h").desc())).alias("after"))
              .join(rest, "cls").where(c("after") >= F.ceil(c("size") * percent / F.lit(100.0))))
    placed = materialize(placed, "open-prefixes")
    sizes = placed.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    entries = placed.join(sizes, "h")
    left = entries.select("h", salt_of(c("m"), c("cls"), PAIRED_ROWS_PER_TASK).alias("salt"), c("cls").alias("a"), c("label").alias("la"),
                          c("size").alias("sa"), c("after").alias("fa"))
    right = entries.select("h", F.explode(salts(c("m"), PAIRED_ROWS_PER_TASK)).alias("salt"), c("cls").alias("b"), c("label").alias("lb"),
                           c("size").alias("sb"), c("after").alias("fb"))
    reach = (100 + percent) * F.least("fa", "fb") >= percent * (c("sa") + c("sb"))
    near = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    met = left.join(right, (left["h"] == right["h"]) & (left["salt"] == right["salt"]) & (c("a") < c("b")) & (c("la") != c("lb")) & near & reach)
    return met.select("a", "b").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def check(batches):
        for batch in batches:
            a, b, i, keep = batch.column("ta"), batch.column("tb"), 0, []
            while i < batch.num_rows:                                   # rows whose two texts have a few MB
                j, size = i, 0
                while j < min(batch.num_rows, i + 2048) and (j == i or size < 1 << 20):
                    size += len(a[j].as_buffer()) + len(b[j].as_buffer())
                    j += 1
                keys, sizes = [], []
                for side in (a, b):
                    data, at = W.flat(side.slice(i, j - i))
                    row, h = W.shingle_sets(W.split(data[at[0]:at[-1]], at - at[0], W.NOT_SPACE), k)
                    keys.append((row.astype(U) << U(52)) | h)
                    sizes.append(np.bincount(row, minlength=j - i))
                both = np.bincount((np.intersect1d(*keys, assume_unique=True) >> U(52)).astype(np.int64), minlength=j - i)
                keep.append(100 * both >= percent * (sizes[0] + sizes[1] - both))
                i = j
            if keep:
                yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))
    sided = (pairs.join(texts.select(c("cls").alias("a"), c("text").alias("ta")), "a")
             .join(texts.select(c("cls").alias("b"), c("text").alias("tb")), "b"))
    return sided.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
                    bands: int = 48, rows: int = 7) -> DataFrame:
    """id, n_shingles, component_id, kept, text_hash (xxhash64) and component_label for each row of ``docs``.

    Words are runs other than ASCII white space, with A-Z in lower case; a
    text's set has its distinct shingles of ``k`` words.  A null or blank text
    has an empty set and is linked with nothing.  Rows that share an id are
    one document.  The component's id is its smallest id; its label tells
    components apart also where ids repeat or are null, and is null for an
    empty set.  A pair at exactly
    80 % similarity shares no bucket with a probability of
    (1 - 0.8 ** 7) ** 48, about 1 in 80,000; above, it falls quickly.  Other
    columns of ``docs`` take no part.  Classes and shingles are told apart by
    64- and 52-bit hashes.  ``docs`` is read twice.
    """
    signed = materialize(signatures(docs, id, text, k, bands, rows), "signatures")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    entries = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    members = materialize(entries.join(shared.select("key"), "key"), "members")

    one = signed.join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(
        F.min(F.struct("id", "mark")).alias("at")).select("cls", "at.*")
    source = docs.select(c(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("mark"), c(f"`{text}`").cast("string").alias("text"))
    texts = materialize(source.join(one, source["id"].eqNullSafe(one["id"]) & (source["mark"] == one["mark"]))
                        .select("cls", "text").dropDuplicates(["cls"]), "class-texts")

    members = materialize(members.join(profiles(texts, k), "cls").select(
        "key", "cls", (c("n") - c("own")).alias("n"), "own", "blocks").where(100 * c("n") >= percent * (c("n") + c("own"))), "members")
    # Cheap bounds from above; most pairs below the threshold need no look at their texts.
    alike = 100 * F.least("na", "nb") >= percent * (F.greatest("na", "nb") + c("oa") + c("ob"))
    common = F.aggregate(F.zip_with("blocks_a", "blocks_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda x, y: x + y)
    alike &= (100 + percent) * common >= percent * (c("na") + c("oa") + c("nb") + c("ob"))
    links = signed.select(c("cls").alias("a"), c("cls").alias("b")).limit(0)
    tested, labels, rounds, productive = links, None, 0, True
    while True:
        alive = members.withColumn("label", c("cls")) if labels is None else members.join(
            labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        alive = materialize(alive, "alive")
        open_ = (alive.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key")
                 .agg(F.sum("m").alias("s"), F.sum(c("m") * c("m")).alias("q"), F.count("*").alias("parts")).where("parts > 1"))
        left, size = open_.agg(F.sum((c("s") * c("s") - c("q")) / 2), F.sum("s")).first()
        if not left:
            break
        alive = alive.join(open_.select("key"), "key")
        star = productive and (rounds == 0 or left > size)
        if star:       # all members of a bucket against one: that with the fewest shingles of its own, later of another component
            first = F.xxhash64("label", F.lit(rounds)) if rounds else F.lit(0)
            pivot = alive.groupBy("key").agg(F.min(F.struct(first.alias("f"), (c("own") / (c("own") + c("n"))).alias("w"),
                                                            "label", "cls", "n", "own", "blocks")).alias("p"))
            pairs = alive.join(pivot, "key").where("label != p.label").select(
                F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"), c("n").alias("na"),
                c("p.n").alias("nb"), c("own").alias("oa"), c("p.own").alias("ob"),
                c("blocks").alias("blocks_a"), c("p.blocks").alias("blocks_b"))
            pairs = pairs.where(alike)
        else:          # what is left between components
            rest = materialize(alive.select("cls", "label", (c("n") + c("own")).alias("size"), "n", "own", "blocks").dropDuplicates(["cls"]), "open")
            sides = [rest.select(c("cls").alias(x), c("n").alias("n" + x), c("own").alias("o" + x), c("blocks").alias("blocks_" + x)) for x in "ab"]
            pairs = rare_pairs(rest.select("cls", "label", "size"), texts, k, percent).join(sides[0], "a").join(sides[1], "b").where(alike)
        pairs = materialize(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        new = materialize(confirm(pairs, texts, k, percent), "links")
        found = new.count()
        productive = 20 * found > pairs.count()
        links, tested = links.union(new), tested.union(pairs)
        if found:
            labels = components(links)
        if not star:
            break
        rounds += 1

    if labels is None:
        labels = links.select(c("a").alias("node"), c("b").alias("label"))
    named = signed.join(labels, c("cls") == c("node"), "left").select(
        "id", "mark", "n_shingles", F.coalesce("label", "cls").alias("label"))
    named = materialize(named, "named")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    return named.join(least, "label", "left").select(
        c("id").alias(id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        c("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"), c("mark").alias("text_hash"), c("label").alias("component_label"))
