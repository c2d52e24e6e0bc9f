"""Portfolio aggregates over the finished risk table."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SIGNAL_LABELS
from ..functions.columns import percent_of, round_even, strip
from .alerts import mean_score
from .proximity import closest_pairs

c = F.col
GROUP_KEYS = {"state": "state", "district": "district", "project_type": "project_type", "contractor": "contractor"}
MIN_GROUP, TOP_GROUPS = 2, 10
#: What ``portfolio_insights`` reads of the risk table.
READ_COLUMNS = ["project_id", *GROUP_KEYS.values(), "status", *[f"{x}_amount" for x in ("sanctioned", "released", "utilized")],
                "overall_risk_score", "alert_required", *SIGNAL_LABELS]


def _money(column: str, cond: Column | None = None) -> Column:
    amount = F.coalesce(c(column), F.lit(0.0))
    return F.coalesce(F.sum(amount if cond is None else F.when(cond, amount)), F.lit(0.0))


def portfolio_totals(alerts: DataFrame) -> DataFrame:
    sums = alerts.agg(
        F.count("*").alias("total_projects"), F.count_if("alert_required").alias("flagged_projects"),
        _money("sanctioned_amount").alias("s"), _money("sanctioned_amount", c("alert_required")).alias("r"))
    return sums.select(
        "total_projects", "flagged_projects",
        percent_of(c("flagged_projects"), c("total_projects")).alias("flagged_percentage"),
        round_even(c("s"), 2).alias("total_sanctioned_amount"),
        round_even(c("r"), 2).alias("sanctioned_amount_at_risk"),
        percent_of(c("r"), c("s")).alias("sanctioned_at_risk_percentage"))


def fund_tracking(projects: DataFrame) -> DataFrame:
    sums = projects.agg(*[_money(f"{x}_amount").alias(x) for x in ("sanctioned", "released", "utilized")])
    return sums.select(
        *[round_even(c(x), 2).alias(f"total_{x}") for x in ("sanctioned", "released", "utilized")],
        round_even(c("released") - c("utilized"), 2).alias("unutilized_funds"),
        percent_of(c("utilized"), c("released")).alias("utilization_rate_percentage"),
        percent_of(c("released"), c("sanctioned")).alias("release_rate_percentage"))


def signal_frequency(alerts: DataFrame) -> DataFrame:
    """One pass, then the single row is turned into ten."""
    counts = alerts.agg(F.count("*").alias("n"), *[F.count_if(c(x)).alias(x) for x in SIGNAL_LABELS])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(label).alias("signal"),
                              c(x).alias("flagged_projects"))
                     for i, (x, label) in enumerate(SIGNAL_LABELS.items())])
    return (counts.select("n", F.explode(rows).alias("r"))
            .select("r.position", "r.signal", "r.flagged_projects",
                    percent_of(c("r.flagged_projects"), c("n")).alias("percentage"))
            .orderBy(c("flagged_projects").desc(), "position").drop("position"))


def status_breakdown(projects: DataFrame) -> DataFrame:
    label = strip(F.coalesce(c("status"), F.lit("")))
    total = projects.agg(F.count("*")).scalar()
    return (projects.groupBy(F.when(label != "", label).otherwise("Unknown").alias("status"))
            .agg(F.count("*").alias("count"))
            .withColumn("percentage", percent_of(c("count"), total))
            .orderBy(c("count").desc(), "status"))


def _group_aggregates() -> list[Column]:
    flagged = c("alert_required")
    return [F.count("project_id").alias("project_count"), mean_score().alias("average_risk_score"),
            F.count_if(flagged).alias("flagged_count"),
            round_even(_money("sanctioned_amount", flagged), 2).alias("sanctioned_amount_at_risk")]


def _group_name(column: str) -> Column:
    return strip(F.coalesce(c(column), F.lit("Unknown")))


def risk_by(alerts: DataFrame, column: str, top: int = TOP_GROUPS) -> DataFrame:
    """Groups with the highest mean score."""
    return (alerts.withColumn("name", _group_name(column)).where(c("name") != "")
            .groupBy("name").agg(*_group_aggregates()).where(c("project_count") >= MIN_GROUP)
            .orderBy(c("average_risk_score").desc(), "name").limit(top))


def risk_by_all(alerts: DataFrame, top: int = TOP_GROUPS) -> DataFrame:
    """All four rankings from one scan.  Rows are spread over the group kinds
    and reduced inside each task before the shuffle; the rank is cut to
    ``top`` per task before the few survivors of a kind meet."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), _group_name(column).alias("name"))
                      for kind, column in GROUP_KEYS.items()])
    best = Window.partitionBy("kind").orderBy(c("average_risk_score").desc(), c("name").asc())
    return (alerts.select("project_id", "overall_risk_score", "alert_required", "sanctioned_amount",
                          F.explode(kinds).alias("g"))
            .select("*", "g.kind", "g.name").where(c("name") != "")
            .groupBy("kind", "name").agg(*_group_aggregates()).where(c("project_count") >= MIN_GROUP)
            .withColumn("position", F.row_number().over(best)).where(c("position") <= top))


def portfolio_insights(alerts: DataFrame, projects: DataFrame | None = None, top_pairs: int = 20) -> dict[str, DataFrame]:
    """All portfolio aggregates by name.  Pass a stored risk table: every
    entry reads it again, though only the columns it needs.  With
    ``projects``, the closest pairs of them are added."""
    out = {"totals": portfolio_totals(alerts), "fund_tracking": fund_tracking(alerts),
           "status_breakdown": status_breakdown(alerts), "signal_frequency": signal_frequency(alerts),
           **{f"risk_by_{kind}": risk_by(alerts, column) for kind, column in GROUP_KEYS.items()}}
    if projects is not None:
        out["geo_overlap_pairs"] = closest_pairs(projects, top_pairs)
    return out
