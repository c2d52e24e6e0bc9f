"""Salting for joins whose work grows faster than their bytes.

Adaptive execution splits partitions that are large in bytes.  A join of
neighbours or of members of one group produces rows in the product of both
sides, so a key can be far too heavy for one task while its bytes look
harmless.  Here the number of salts follows from the size ``n`` of the key:
one side picks a salt by hash, the other is repeated once per salt, and each
task meets at most about ``rows_per_task`` rows of the salted side.  Keys
below that size keep the single salt 0 and cost nothing.
"""

from pyspark.sql import Column, DataFrame, functions as F

ROWS_PER_TASK = 20_000          # joins whose output is a product of both sides
LOOKUP_ROWS_PER_TASK = 1_000_000
BROADCAST_KEYS = 100_000
SENT_KEYS = 1_000_000           # keys alone, where the rows that stay in place are wide


def _count(n: Column, rows_per_task: int) -> Column:
    return F.ceil(F.coalesce(n, F.lit(1)) / F.lit(rows_per_task)).cast("int")


def salt_of(n: Column, row_key: Column, rows_per_task: int = ROWS_PER_TASK) -> Column:
    """Salt of a row on the split side."""
    return F.pmod(F.xxhash64(row_key), F.greatest(_count(n, rows_per_task), F.lit(1))).cast("int")


def salts(n: Column, rows_per_task: int = ROWS_PER_TASK) -> Column:
    """Array of all salts, to be exploded on the repeated side."""
    return F.sequence(F.lit(0), F.greatest(_count(n, rows_per_task), F.lit(1)) - 1)


def crowded_keys(df: DataFrame, keys: list[str], limit: int, most: int = BROADCAST_KEYS,
                 sizes: DataFrame | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows and their size ``n``; None if there
    are none, which is the usual case.  ``sizes`` has the keys and ``n``, where they are counted already.

    At most ``rows / limit`` keys qualify.  Up to ``most`` of them are sent to all tasks; beyond that the join is left to shuffle.
    """
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.where(F.col("n") > limit)
    found = sizes.limit(most + 1).collect()
    if not found:
        return None
    if len(found) > most:
        return sizes
    return F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))


def lookup_join(facts: DataFrame, table: DataFrame, key: str | list[str], row_key: str,
                limit: int = LOOKUP_ROWS_PER_TASK, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Join (inner or left) of facts to a table with one row per key.

    Adaptive execution does not split a crowded key when the next step groups
    by the same key, because the split would need one more shuffle.  Crowded
    keys are salted here, so the grouping combines in many tasks first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    crowded = crowded_keys(facts, keys, limit, sizes=sizes)
    if crowded is None:
        return facts.join(table, keys, how)
    spread = facts.join(crowded, keys, "left").withColumn("_salt", salt_of(F.col("n"), F.col(row_key), limit)).drop("n")
    copies = table.join(crowded, keys, "left").withColumn("_salt", F.explode(salts(F.col("n"), limit))).drop("n")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
