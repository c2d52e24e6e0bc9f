"""Isolation forest over project features (Liu, Ting & Zhou, 2008).

Nothing is drawn from a generator.  Samples, split features and split points
follow from the MD5 of (seed, tree, node) or (seed, round, project id), so
the model depends neither on the partitioning nor on the order of rows, a
task that is run again grows the same trees, and SQL can repeat the model.

Fitting touches a bounded sample: at most 256 rows per tree.  The rows of a
tree are brought together once; then every level is a window over (tree,
node), which needs no further shuffle.  The finished forest has at most
``trees * 511`` nodes whatever the size of the portfolio, so it can be sent
to every task.  Scoring is a vectorised pass over all rows that adds whole
numbers, so sums do not depend on their order.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import OUTLIER_FEATURES
from ..functions.columns import round_even
from ..plans.materialize import materialize, spread
from ..plans.quantiles import quantiles
from . import trees as _trees
from .trees import UNIT, path_units, total_units

# The tree helpers travel inside the tasks: executors need no installed package.
cloudpickle.register_pickle_by_value(_trees)

MIN_ROWS = 20
TREES, SUBSAMPLE, CONTAMINATION, SEED = 200, 256, 0.05, 42

c = F.col


@dataclass
class FeatureStats:
    """What the gate and the imputation know about the features."""
    rows: int
    features: list[str]
    medians: dict[str, float]

    @property
    def usable(self) -> bool:
        return len(self.features) >= 2 and self.rows >= MIN_ROWS


def feature_gate(features: DataFrame, columns=tuple(OUTLIER_FEATURES)) -> DataFrame:
    """One row: number of projects and of values per feature."""
    return features.agg(F.count("*").alias("rows"), *[F.count(x).alias(x) for x in columns])


def feature_stats(features: DataFrame, columns=tuple(OUTLIER_FEATURES), rank_error: float | None = None) -> FeatureStats:
    """Features with enough values, and their medians (exact, or within a rank error)."""
    row = feature_gate(features, columns).first()
    used = [x for x in columns if row[x] >= MIN_ROWS]
    stats = FeatureStats(row.rows, used, {})
    if stats.usable:
        stats.medians = quantiles(features.select(*[c(x).cast("double").alias(x) for x in used]), used, 0.5, rank_error)
    return stats


def impute(features: DataFrame, stats: FeatureStats) -> DataFrame:
    return features.select("project_id", *[
        F.coalesce(c(x).cast("double"), F.lit(stats.medians[x])).alias(x) for x in stats.features])


def top_feature(imputed: DataFrame, stats: FeatureStats) -> DataFrame:
    """The feature farthest from its median in standard deviations."""
    row = imputed.agg(*[F.stddev_samp(x).alias(x) for x in stats.features]).first()
    z = []
    for i, x in enumerate(stats.features):
        deviation = row[x] if row[x] else 1.0
        z.append(F.struct((F.abs(c(x) - F.lit(stats.medians[x])) / F.lit(deviation)).alias("z"),
                          F.lit(-i).alias("first"), F.lit(x).alias("name")))
    best = F.array_max(F.array(*z))
    return imputed.withColumns({"ml_top_feature": best["name"], "ml_top_feature_z": round_even(best["z"], 2)})


# --- forest -----------------------------------------------------------------

DIGITS = 13         # of the hexadecimal hash: 52 bits, exact in a double


def share_of(*parts) -> Column:
    """A number in [0, 1) that follows from the given parts."""
    words = [c(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x for x in parts]
    mark = F.md5(F.concat_ws(" ", *[w.cast("string") for w in words]).cast("binary"))
    return F.conv(F.substring(mark, 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16 ** DIGITS))


def draw_samples(imputed: DataFrame, rows: int, trees: int, subsample: int, seed: int) -> DataFrame:
    """Up to ``subsample`` rows for each tree, without replacement.

    One formula at every size.  A round deals all rows out, by hash of the
    id, to as many trees as have at least about ``2 * subsample`` rows each;
    there are as many rounds as the trees need.  Each tree takes the rows
    with the smallest hash.  A large portfolio has one round, and only the
    rows of the wanted trees are looked at again.
    """
    slots = max(1, rows // (2 * subsample))
    rounds = -(-trees // slots)
    dealt = (imputed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
             .withColumn("share", share_of(seed, F.lit("row"), "round", "project_id"))
             .withColumn("tree", (c("round") * slots + F.floor(c("share") * slots)).cast("int")).where(c("tree") < trees))
    # Ranking with a constant limit is cut in each task before the shuffle, also where one id has many rows.
    order = Window.partitionBy("tree").orderBy("share", "project_id", *[x for x in imputed.columns if x != "project_id"])
    return (dealt.withColumn("_place", F.row_number().over(order)).where(c("_place") <= subsample)
            .drop("round", "share", "_place"))


def grow(samples: DataFrame, columns: list[str], depth: int, seed: int, trees: int = TREES) -> DataFrame:
    """Split every node of two or more different rows, ``depth`` times.

    Nodes are numbered like a heap: the root is 1, the children of n are 2 n
    (up to the split) and 2 n + 1.  Returns the samples with the node ``at``
    they end in, and ``steps``: (node, feature, split) of each level.
    """
    node = Window.partitionBy("tree", "at")
    # A few megabytes with costly rows: a given number of partitions is not coalesced.
    tasks = min(trees, 4 * samples.sparkSession.sparkContext.defaultParallelism)
    grown = samples.repartition(tasks, "tree").select("tree", F.array(*columns).alias("x"), F.lit(1).cast("bigint").alias("at"),
                                               F.array().cast("array<struct<node:bigint,feature:int,split:double>>").alias("steps"))
    for level in range(depth):
        bounds = [F.struct(F.lit(i).alias("feature"), F.min(c("x")[i]).over(node).alias("low"), F.max(c("x")[i]).over(node).alias("high"))
                  for i in range(len(columns))]
        grown = grown.withColumn("open", F.filter(F.array(*bounds), lambda b: b["high"] > b["low"]))
        splits = (c("at") >= 1 << level) & (F.size("open") > 0)
        pick = F.floor(share_of(seed, F.lit("feature"), "tree", "at") * F.size("open")).cast("int")
        grown = grown.withColumn("pick", F.when(splits, F.get("open", pick)))
        low, high = c("pick")["low"], c("pick")["high"]
        point = low + share_of(seed, F.lit("split"), "tree", "at") * (high - low)
        split = F.when(point < high, point).otherwise(low)      # neighbouring numbers: rounding must not leave one side empty
        grown = grown.withColumn("step", F.when(c("pick").isNotNull(), F.struct(
            c("at").alias("node"), c("pick")["feature"].alias("feature"), split.alias("split"))))
        right = (F.get("x", c("step")["feature"]) > c("step")["split"]).cast("int")
        grown = grown.select("tree", "x", F.when(c("step").isNull(), c("at")).otherwise(c("at") * 2 + right).alias("at"),
                             F.array_compact(F.array_append("steps", c("step"))).alias("steps"))
    return grown.select("tree", "at", "steps")


@dataclass
class Forest:
    """By tree and node number: the feature of a split (-1: none) and its
    value, and what a row gains that ends there."""
    features: list[str]
    depth: int
    feature: np.ndarray
    split: np.ndarray
    units: np.ndarray


def fit_forest(imputed: DataFrame, stats: FeatureStats, trees: int = TREES, subsample: int = SUBSAMPLE,
               seed: int = SEED) -> Forest:
    size = min(subsample, stats.rows)
    columns, depth = list(stats.features), max(1, math.ceil(math.log2(max(size, 2))))
    grown = materialize(grow(draw_samples(imputed, stats.rows, trees, subsample, seed), columns, depth, seed, trees), "forest")
    # At most trees * 511 rows of each kind.
    splits = grown.select("tree", F.explode("steps").alias("s")).groupBy("tree", "s.node").agg(
        F.min("s.feature").alias("feature"), F.min("s.split").alias("split")).toPandas()
    leaves = grown.groupBy("tree", "at").agg(F.count("*").alias("rows")).toPandas()
    shape = (trees, 2 << depth)
    feature, split, rows = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int64)
    feature[splits["tree"], splits["node"]] = splits["feature"]
    split[splits["tree"], splits["node"]] = splits["split"]
    rows[leaves["tree"], leaves["at"]] = leaves["rows"]
    return Forest(columns, depth, feature, split, path_units(rows))


def score_rows(imputed: DataFrame, forest: Forest) -> DataFrame:
    """-2^(-mean path / expected path): -1 is most isolated, 0 least."""
    # At most trees * 512 nodes, whatever the size of the portfolio.
    shared = imputed.sparkSession.sparkContext.broadcast((forest.feature, forest.split, forest.units))
    depth, trees = forest.depth, len(forest.feature)

    @F.pandas_udf(T.LongType())
    def total_path(*columns: pd.Series) -> pd.Series:
        return pd.Series(total_units(*shared.value, depth, np.column_stack([s.to_numpy(dtype=float) for s in columns])))

    mean = total_path(*[c(x) for x in forest.features]) / F.lit(float(trees * UNIT))
    return imputed.withColumn("_raw", -F.pow(F.lit(2.0), -mean))


def ml_outliers(features: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE,
                contamination: float = CONTAMINATION, seed: int = SEED,
                rank_error: float | None = None) -> tuple[DataFrame, bool]:
    """Outlier flag, 0-100 score and leading feature per project, and whether
    there was enough data to fit a model.

    Medians and the cut of the flagged share are exact; ``rank_error`` takes
    them from a sketch in one pass instead, that share of the rows off at most.
    """
    # One pass over the portfolio; all later passes read five narrow columns.
    table = materialize(features.select("project_id", *[
        c(x).cast("double").alias(x) for x in OUTLIER_FEATURES]), "outlier-features")
    stats = feature_stats(table, rank_error=rank_error)
    if not stats.usable:
        return table.select(
            "project_id", F.lit(False).alias("ml_anomaly"), F.lit(0.0).alias("ml_anomaly_score"),
            F.lit("").alias("ml_top_feature"), F.lit(None).cast("double").alias("ml_top_feature_z"),
            F.lit(False).alias("ml_signal_available")), False
    imputed = impute(table, stats)
    forest = fit_forest(imputed, stats, trees, subsample, seed)
    scored = materialize(top_feature(score_rows(spread(imputed, stats.rows), forest), stats), "outlier-scores")
    cut = quantiles(scored, ["_raw"], contamination, rank_error)["_raw"]
    low, high = scored.agg(F.min("_raw"), F.max("_raw")).first()
    scaled = (F.lit(0.0) if high - low < 1e-9
              else round_even((F.lit(high) - c("_raw")) / F.lit(high - low) * F.lit(100.0), 2))
    return scored.select(
        "project_id", (c("_raw") < F.lit(cut)).alias("ml_anomaly"), scaled.alias("ml_anomaly_score"),
        "ml_top_feature", "ml_top_feature_z", F.lit(True).alias("ml_signal_available")), True
