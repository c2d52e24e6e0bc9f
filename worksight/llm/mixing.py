"""Mix sources to target weights by entropy balancing.

Every document gets a rate between 0 and 2, the number of copies the mix
should take.  Among all rates whose words per source meet the targets, the
ones closest to 1 in relative entropy (of a two-copy binomial) are an
exponential tilt in the document's size: ``2 / (1 + exp(-lambda * size))``
with one multiplier per source.  The multipliers solve a convex dual; each
Newton step is one distributed aggregation.  Rates become whole copies by
carrying the words that rounding leaves over from the largest sizes to the
smallest.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.materialize import materialize

c = F.col
NO_SOURCE = "2"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit(NO_SOURCE)).otherwise(F.concat(F.lit("1"), source.cast("string")))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target words per source: ``share`` of all words by repeating weights in
    key order, none above ``cap`` times its source; the excess goes to the
    others by weight until none is above.  ``sources``: key, total."""
    # Positions inside range partitions plus their offsets: no task sees all sources.
    parts = sources.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "mix-sources")
    # One row for each partition, so this window is bounded by their number.
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + c("before")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialize(parts.join(before, "part").select(
        "key", "total", F.element_at(table, (rank % len(weights) + 1).cast("int")).alias("weight")), "mix-weights")

    words, weight = weighed.agg(F.sum("total"), F.sum("weight")).first()
    per_weight, capped = share * (words or 0) / (weight or 1), -1
    while True:
        full = c("weight") * per_weight >= cap * c("total")
        n, taken, free = weighed.agg(F.count(F.when(full, 1)), F.sum(F.when(full, cap * c("total")).otherwise(0.0)),
                                     F.sum(F.when(full, 0.0).otherwise(c("weight")))).first()
        if n == capped or not free:
            break
        per_weight, capped = (share * words - taken) / free, n
    return weighed.withColumn("target", F.least(c("weight") * F.lit(float(per_weight)), cap * c("total")))


def tilt(classes: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-7) -> DataFrame:
    """The multiplier of each source: key, scale, lam, full.

    ``classes``: key, size, n; ``goals``: key, total, target.  Newton steps
    that leave the known bracket are replaced by bisection, so the loop ends
    for every input.  A source at its cap is ``full``: rate ``cap``.
    """
    scale = classes.groupBy("key").agg((F.sum(c("n") * c("size") * c("size")) / F.sum(c("n") * c("size"))).alias("scale"))
    free = (c("target") > 0) & (c("target") < cap * c("total") * (1 - 1e-9))
    state = goals.join(scale, "key").select(
        "key", "target", "scale", (c("target") >= cap * c("total") * (1 - 1e-9)).alias("full"), free.alias("open"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    state = materialize(state, "mix-state")
    while True:
        rate = F.lit(cap) / (1 + F.exp(-F.greatest(F.least(c("lam") * c("size") / c("scale"), F.lit(700.0)), F.lit(-700.0))))
        words = c("n") * c("size") * rate
        sums = classes.join(state.where("open").select("key", "scale", "lam"), "key").groupBy("key").agg(
            F.sum(words).alias("f"), F.sum(words * (1 - rate / cap) * c("size") / c("scale")).alias("slope"))
        low = F.when(c("f") <= c("target"), c("lam")).otherwise(c("lo"))
        high = F.when(c("f") >= c("target"), c("lam")).otherwise(c("hi"))
        done = F.abs(c("f") - c("target")) <= tolerance * c("target") + 1e-9
        newton = c("lam") + (c("target") - c("f")) / c("slope")
        reach = 1 + 2 * F.abs(c("lam"))
        newton = F.when(c("slope") > 0, newton)
        step = (F.when(c("low").isNotNull() & c("high").isNotNull(),
                       F.when((newton > c("low")) & (newton < c("high")), newton).otherwise((c("low") + c("high")) / 2))
                .when(c("low").isNull(), F.greatest(F.coalesce(newton, c("lam") - reach), c("lam") - reach))
                .otherwise(F.least(F.coalesce(newton, c("lam") + reach), c("lam") + reach)))
        moved = (state.join(sums, "key", "left").withColumns({"low": low, "high": high, "done": done})
                 .select("key", "target", "scale", "full", (c("open") & ~c("done") & (F.coalesce(c("high") - c("low"), F.lit(1.0)) > 1e-13)).alias("open"),
                         F.when(c("open") & ~c("done"), step).otherwise(c("lam")).alias("lam"), c("low").alias("lo"), c("high").alias("hi")))
        state = materialize(moved, "mix-state")
        if not state.where("open").limit(1).count():
            return state.select("key", "scale", "lam", "full", "target")


def _round(cap: float):
    def copies(group: pd.DataFrame) -> pd.DataFrame:
        """Whole copies per size class of one source, largest size first; what
        rounding leaves over is carried on.  A group has a row for each
        distinct size, so it is bounded by the longest document."""
        group = group.sort_values("size", ascending=False, ignore_index=True)
        left, out = 0.0, np.zeros(len(group), dtype=np.int64)
        for i, (size, n, rate) in enumerate(zip(group["size"], group["n"], group["rate"], strict=True)):
            wanted = n * size * rate + left
            out[i] = min(max(round(wanted / size), 0), int(cap * n)) if size else n
            left = wanted - out[i] * size
        return group.assign(copies=out)[["key", "size", "n", "copies"]]
    return copies


def mix(docs: DataFrame, source: str = "source", id: str = "doc_id", size: str = "size",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0,
        rows_per_bucket: int = 1_000_000) -> DataFrame:
    """The columns of ``docs`` plus source_size, target and copies.

    ``size`` names a column of whole numbers (words of the document).  Null
    sources are one source, last in order.  Documents without words are taken
    once; they carry no words.  ``docs`` is read twice, so it should be a
    stored table.  Copies of equal documents are told apart by a hash of the
    id; rows equal in id are interchangeable.  Columns may have any name; one
    named as an added column is replaced.  An empty table gives an empty one.
    """
    keyed = docs.select(F.struct("*").alias("row"), source_key(c(f"`{source}`")).alias("key"), c(f"`{id}`").alias("id"),
                        c(f"`{size}`").alias("size"), F.xxhash64(c(f"`{id}`"), F.lit(29)).alias("h"))
    classes = materialize(keyed.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-classes")
    goals = materialize(targets(classes.groupBy("key").agg(F.sum(c("n") * c("size")).alias("total")),
                                weights, share, cap), "mix-goals")
    state = tilt(classes.where("size > 0"), goals, cap)
    power = F.greatest(F.least(c("lam") * c("size") / c("scale"), F.lit(700.0)), F.lit(-700.0))
    rate = F.when(c("full"), F.lit(cap)).when(c("target") > 0, F.lit(cap) / (1 + F.exp(-power))).otherwise(0.0)
    rated = classes.join(state, "key", "left").select("key", "size", "n", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    whole = materialize(rated.groupBy("key").applyInPandas(_round(cap), "key string, size long, n long, copies long"),
                        "mix-copies")

    # Which documents of a class get one copy more: the first by hash.  A class is ranked in
    # buckets, so one that holds a third of all rows is no single task.
    rows = classes.agg(F.sum("n")).first()[0] or 0
    buckets = 16 + rows // rows_per_bucket
    keyed = keyed.withColumn("b", F.pmod("h", F.lit(buckets)))
    counts = keyed.groupBy("key", "size", "b").agg(F.count("*").alias("in_bucket"))
    ahead = F.sum("in_bucket").over(Window.partitionBy("key", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    plan = (counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).join(whole, ["key", "size"])
            .join(goals.select("key", c("total").alias("source_size"), "target"), "key")
            .select("key", c("size").alias("_size"), "b", "ahead", "source_size", "target",
                    F.floor(c("copies") / c("n")).alias("each"), (c("copies") % c("n")).alias("more")))
    x, y = keyed.alias("x"), plan.alias("y")
    joined = x.join(y, (c("x.key") == c("y.key")) & (c("x.size") == c("y._size")) & (c("x.b") == c("y.b")))
    place = F.row_number().over(Window.partitionBy("x.key", "x.size", "x.b").orderBy("x.h", "x.id")) + c("ahead")
    added = ("source_size", "target", "copies")
    return joined.withColumn("_place", place).select(
        *[c("x.row")[k].alias(k) for k in docs.columns if k not in added], "source_size", "target",
        (c("each") + F.when(c("_place") <= c("more"), 1).otherwise(0)).alias("copies"))
