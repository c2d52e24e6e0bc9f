"""Rank over a whole table without one task that sees all rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .materialize import materialize


def global_rank(df: DataFrame, order: list[Column], column: str, partitions: int | None = None) -> DataFrame:
    """Add the position 1..n in the given order.

    The order must be total (end it with a unique key).  Range partitioning
    puts the partitions themselves in order; each task numbers its own rows,
    and the sizes of the earlier partitions shift them.

    Range boundaries come from a sample of the input.  The input is written
    first, so that sampling does not compute it a second time, and so are the
    numbered rows: other boundaries in a second run would break the numbering.
    """
    df = materialize(df, "to-rank")
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The upper bits hold the partition, the lower 33 the position inside it.
    placed = materialize(
        numbered.withColumns({"_part": F.shiftright("_id", 33),
                              "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"),
        "ranked")
    # One row per range partition, so the unpartitioned window is over a
    # table bounded by the partition count; so is the broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg((F.max("_pos") + 1).alias("_rows"))
               .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(column, F.col("_before") + F.col("_pos") + 1)
            .drop("_part", "_pos", "_before"))
