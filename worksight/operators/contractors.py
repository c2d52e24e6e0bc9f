"""Track record of each contractor and its effect on the projects."""

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import ladder, points, strip
from ..plans.skew import LOOKUP_ROWS_PER_TASK, lookup_join

c = F.col


def contractor_key(column="contractor"):
    return strip(F.coalesce(c(column), F.lit("Unknown")))


def contractor_history(features: DataFrame) -> DataFrame:
    """One conditional aggregate; a contractor with most of the projects is
    reduced inside each task before the shuffle."""
    totals = features.groupBy(contractor_key().alias("contractor")).agg(
        F.count("project_id").alias("total_projects"),
        F.avg("completion_percentage").alias("average_completion"),
        F.avg("delay_days").alias("average_delay_days"),
        F.coalesce(F.sum("utilized_amount"), F.lit(0.0)).alias("total_utilized_amount"),
        F.count_if(F.lower("status") == "delayed").alias("delayed_projects"),
        F.count_if(c("progress_mismatch_abs") > 30).alias("progress_mismatch_projects"))
    late, off = c("delayed_projects"), c("progress_mismatch_projects")
    scored = totals.withColumn("contractor_risk_score", points(
        (late >= 2, 30), (late >= 5, 20), (off >= 2, 25), (off >= 5, 15), (c("average_completion") < 50, 20)))
    return scored.withColumn("risk_level", ladder(
        c("contractor_risk_score"), [(70, "HIGH"), (40, "MEDIUM")], "LOW"))


def contractor_scores(features: DataFrame, limit: int = LOOKUP_ROWS_PER_TASK) -> DataFrame:
    """Score of the contractor for each project; every project without one is under the same name, so crowded
    names are salted."""
    history = contractor_history(features).select("contractor", "contractor_risk_score")
    score = F.coalesce(c("contractor_risk_score"), F.lit(0.0))
    named = features.select("project_id", contractor_key().alias("contractor"))
    return (lookup_join(named, history, "contractor", "project_id", limit)
            .select("project_id", score.alias("contractor_risk_score"), (score >= 70).alias("contractor_anomaly")))
