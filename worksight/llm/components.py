"""Connected components as joins; labels and links stay distributed."""

from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import materialize

c = F.col


def components(links: DataFrame) -> DataFrame:
    """node, label for each end of ``links`` (a, b); the label is the smallest node that can be reached.

    Each round takes the smallest label among the neighbours, then the label
    of that label, so long chains halve.  Each round is written, which cuts
    the lineage.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy(c("a").alias("node")).agg(F.least(c("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = (both.join(labels, c("b") == c("node")).groupBy(c("a").alias("node")).agg(F.min("label").alias("near")))
        best = labels.join(near, "node").select("node", c("label").alias("before"), F.least("label", "near").alias("label"))
        up = labels.select(c("node").alias("label"), c("label").alias("up"))
        moved = best.join(up, "label", "left").select(
            "node", "before", F.least("label", F.coalesce("up", "label")).alias("label"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", "label")
        if not moved.where("label != before").limit(1).count():
            return labels
