"""Shards of near-equal bytes by sampled splitters.

Records are ordered by a hash of their text, so equal texts are neighbours.
A size-weighted sample of the keys gives quantile boundaries of many small
ranges; their exact bytes and rows are counted, overfull ranges are divided
again, and consecutive ranges fill the shards.  A text whose copies alone
overfill a range is its own range.  It stays in one shard as long as it fits
there; beyond that it is divided by a hash of the id.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.materialize import materialize

c = F.col
FINE = 1 << 30
MOST_CELLS = 1 << 15          # ranges that the driver holds
MOST_SAMPLED = 1 << 19        # keys expected in the first sample


def _array(values: list[int]) -> Column:
    # One text literal, folded once; thousands of literals would make a huge plan.
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cell_of(key: Column, splitters: list[int]) -> Column:
    """How many of the sorted splitters are not above the key, by binary search."""
    if not splitters:
        return F.lit(0)
    bits = max(1, math.ceil(math.log2(len(splitters) + 1)))
    padded = _array(splitters + [None] * 0)
    n = len(splitters)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda acc, step: F.when(
        (acc + step <= n) & (F.element_at(padded, F.least(acc + step, F.lit(n))) <= key), acc + step).otherwise(acc))


def _quantiles(sample: list, cells: int) -> list[int]:
    """Keys at which the weight of the sorted sample passes a multiple of its total / cells."""
    total, seen, cuts = sum(w for _, w in sample), 0.0, []
    for key, weight in sorted(sample):
        if seen > 0 and int(seen * cells / total) > len(cuts):
            cuts += [key] * (int(seen * cells / total) - len(cuts))
        seen += weight
    return sorted(set(cuts))


def _place(light: list, heavy: list[list], n_shards: int) -> dict[int, int]:
    """Shard of each cell.  ``light``: (cell, bytes) in key order; ``heavy``: one list of such pieces for each text."""
    total = sum(b for _, b in light) + sum(b for text in heavy for _, b in text)
    share, loads, shard = total / n_shards, [0] * n_shards, {}
    units = [u for text in heavy for u in ([text] if sum(b for _, b in text) <= share else [[p] for p in text])]
    for unit in sorted(units, key=lambda u: (-sum(b for _, b in u), u)):
        to = min(range(n_shards), key=lambda s: (loads[s], s))
        loads[to] += sum(b for _, b in unit)
        shard |= {cell: to for cell, _ in unit}
    rest, level = sum(b for _, b in light), 0.0
    for k, load in enumerate(sorted(loads), 1):      # the level to which the ranges fill the shards up
        level = (rest + sum(sorted(loads)[:k])) / k
        if k == n_shards or level <= sorted(loads)[k]:
            break
    room, to, filled = [max(0.0, level - load) for load in loads], 0, 0.0
    for cell, size in light:
        while to < n_shards - 1 and filled + size / 2 > room[to]:
            filled -= room[to]
            to += 1
        shard[cell] = to
        filled += size
    return shard


def shard(docs: DataFrame, n_shards: int = 16, id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
          cells_per_shard: int = 64, oversample: int = 32, cell_size: int = 1 << 28) -> DataFrame:
    """Columns ``carry`` (all of them by default), then size, text_crc32, law,
    shard, slot and grown_shard.

    The size of a record is the number of its UTF-8 bytes plus 1; a null text
    has none and counts as empty.  There are ``n_shards * cells_per_shard``
    ranges, more where these would hold over ``cell_size`` bytes, since one
    task orders a range; at most MOST_CELLS, and each over three times the
    mean is divided again.  The sample has about ``oversample`` keys for each
    (fewer, but 8 at least, beyond MOST_SAMPLED in all); it sets boundaries
    only, all counts are exact.  Texts that fill a range alone are at most
    twice as many as ranges, so they, the boundaries and the ranges fit into
    the driver at any input size.  Equal records may swap slots.  An empty
    table gives an empty table.  A carried column that has the name of an
    added one is replaced.
    """
    body = F.coalesce(c(f"`{text}`").cast("string"), F.lit(""))
    added = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    kept = [x for x in (docs.columns if carry is None else carry) if x not in added]
    keyed = docs.select(F.struct(*[c(f"`{x}`") for x in kept]).alias("row"),
                        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("crc"),
                        F.xxhash64(body).alias("key"), F.xxhash64(c(f"`{id}`"), body).alias("tie"))
    spark = docs.sparkSession
    narrow = materialize(keyed.select("key", "tie", "size"), "shard-keys")
    n, size = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = n_shards * max(cells_per_shard, min(-(-size // (n_shards * cell_size)), MOST_CELLS // n_shards))
    cell_rows, cell_bytes = max(1.0, n / cells), max(1.0, size / cells)

    crowded = (narrow.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
               .where((c("n") > cell_rows) & (c("n") > 1) | (c("b") > cell_bytes)).collect())
    base, texts, heavy_rows = 1 << 40, [], []
    for key, rows, total in sorted(crowded):
        pieces = max(1, min(rows, math.ceil(max(rows / cell_rows, total / cell_bytes))))
        heavy_rows.append((key, base, pieces))
        texts.append((base, pieces))
        base += pieces
    heavy = F.broadcast(spark.createDataFrame(heavy_rows, "key long, base long, pieces long"))
    marked = narrow.join(heavy, "key", "left")

    def weight():
        return (c("size") / F.lit(float(max(size, 1))) + F.lit(1.0 / max(n, 1))) / 2

    def sample(rows: DataFrame, rate: float) -> list:
        odds = weight() * F.lit(float(rate))
        chance = F.pmod(F.xxhash64("key", "tie", F.lit(17)), F.lit(FINE)) / F.lit(float(FINE))
        return [(k, w) for k, w in rows.where(chance < odds).select("key", F.greatest(odds, F.lit(1.0))).collect()]

    light, rate = marked.where(c("pieces").isNull()), cells * max(8, min(oversample, MOST_SAMPLED // cells))
    splitters = _quantiles(sample(light, rate), cells)
    while True:
        cell = F.when(c("pieces").isNotNull(), c("base") + F.pmod("tie", c("pieces"))).otherwise(
            cell_of(c("key"), splitters).cast("long"))
        found = marked.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
        full = [x.cell for x in found if x.cell < 1 << 40 and (x.n > 3 * cell_rows + 1 or x.b > 3 * cell_bytes)]
        if not full or rate > 64.0 * max(n, 1):
            break
        rate *= 8
        inside = light.withColumn("cell", cell_of(c("key"), splitters)).where(c("cell").isin(full))
        more = sample(inside, rate)
        bounds = [-(1 << 63), *splitters, (1 << 63) - 1]
        for at in full:
            own = [x for x in more if bounds[at] <= x[0] and (x[0] < bounds[at + 1] or at == len(splitters))]
            splitters = splitters + (_quantiles(own, 8) if own else [])
        splitters = sorted(set(splitters))

    sizes = {x.cell: (x.n, x.b) for x in found}
    pieces = [[(x, sizes[x][1]) for x in range(first, first + p) if x in sizes] for first, p in texts]
    shards = _place([(x, sizes[x][1]) for x in sorted(sizes) if x < 1 << 40], pieces, n_shards)
    offset, cell_table = [0] * n_shards, []
    for x in sorted(sizes):
        cell_table.append((x, shards[x], offset[shards[x]]))
        offset[shards[x]] += sizes[x][0]
    cells_df = F.broadcast(spark.createDataFrame(cell_table, "cell long, shard int, offset long"))

    placed = keyed.join(heavy, "key", "left").withColumn("cell", cell).join(cells_df, "cell")
    order = Window.partitionBy("cell").orderBy("key", "tie", "crc")
    return placed.withColumn("slot", c("offset") + F.row_number().over(order) - 1).select(
        *[c("row")[x].alias(x) for x in kept], "size", c("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
