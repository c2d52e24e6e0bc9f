"""Citizen reports and officers' decisions: append-only tables.

The functions take and return frames and run unchanged on a stream (see
``worksight.streaming``): the only join is a left join to the static list of
projects.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import DECISIONS, REPORT_CATEGORIES
from ..functions.columns import strip

c = F.col
OFFICER = "Demo Officer"
POINTS_PER_REPORT, MAX_POINTS = 25, 100


def _with_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    known = projects.select(strip("project_id").alias("project_id")).distinct()
    return rows.join(known.withColumn("_known", F.lit(True)), "project_id", "left")


def _first_reason(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in checks])


def normal_reports(submitted: DataFrame) -> DataFrame:
    optional = [x for x in ("reporter_name", "reporter_contact") if x in submitted.columns]
    rows = submitted.withColumns({
        "project_id": strip(c("project_id").cast("string")),
        "category": strip(F.upper("category")),
        "description": strip("description"),
        **{x: F.coalesce(strip(x), F.lit("")) for x in optional},
    })
    if "submitted_at" not in submitted.columns:
        rows = rows.withColumn("submitted_at", F.current_timestamp())
    return rows


def judge_reports(rows: DataFrame) -> DataFrame:
    """Normalised rows with ``_known`` (null or false: no such project) get their ``reject_reason``."""
    return rows.withColumn("reject_reason", _first_reason(
        (~c("_known"), "project not found"),
        (~c("category").isin(REPORT_CATEGORIES), "invalid category"),
        (c("description") == "", "description required"))).drop("_known")


def check_reports(submitted: DataFrame, projects: DataFrame) -> DataFrame:
    """Normalised submissions with ``reject_reason`` (NULL when accepted)."""
    return judge_reports(_with_project(normal_reports(submitted), projects))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(c("reject_reason").isNull()).drop("reject_reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(c("reject_reason").isNotNull())


def normal_decisions(submitted: DataFrame, verified_by: str = OFFICER) -> DataFrame:
    rows = submitted.withColumns({
        "project_id": strip(c("project_id").cast("string")),
        "decision": strip(F.upper("decision")),
        "remarks": F.coalesce(c("remarks"), F.lit("")),
        "verified_by": F.lit(verified_by),
    })
    if "verification_date" not in submitted.columns:
        rows = rows.withColumn("verification_date", F.current_timestamp())
    return rows


def judge_decisions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", _first_reason(
        (~c("decision").isin(DECISIONS), "invalid decision"),
        (~c("_known"), "project not found"))).drop("_known")


def check_decisions(submitted: DataFrame, projects: DataFrame, verified_by: str = OFFICER) -> DataFrame:
    return judge_decisions(_with_project(normal_decisions(submitted, verified_by), projects))


def append(accepted_rows: DataFrame, path: str) -> None:
    """Add rows to the append-only table."""
    accepted_rows.write.mode("append").parquet(path)


def reports_of(reports: DataFrame, project_id: str, order: str = "report_id") -> DataFrame:
    """Newest first, without the reporter's contact."""
    shown = [x for x in ("project_id", "category", "description", "reporter_name", "submitted_at")
             if x in reports.columns]
    return (reports.where(c("project_id") == project_id.strip())
            .orderBy(c(order).desc()).select(order, *shown))


def decisions_of(verifications: DataFrame, project_id: str, order: str = "verification_id",
                 newest_first: bool = False) -> DataFrame:
    shown = [x for x in ("project_id", "decision", "remarks", "verified_by", "verification_date")
             if x in verifications.columns]
    by = c(order).desc() if newest_first else c(order).asc()
    return verifications.where(c("project_id") == project_id.strip()).orderBy(by).select(order, *shown)


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("project_id").agg(F.count("*").alias("citizen_report_count"))


def report_status(asked: DataFrame, projects: DataFrame, reports: DataFrame) -> DataFrame:
    """For each asked ``project_id``: whether there is such a project, and how many reports it has.

    Tells an unknown project (False, 0) from one without reports (True, 0).
    """
    ids = asked.select(strip(c("project_id").cast("string")).alias("project_id")).where("project_id is not null").distinct()
    known = projects.select("project_id").distinct().withColumn("known", F.lit(True))
    return (ids.join(known, "project_id", "left").join(report_counts(reports), "project_id", "left")
            .select("project_id", F.coalesce("known", F.lit(False)).alias("known"),
                    F.coalesce("citizen_report_count", F.lit(0)).alias("citizen_report_count")))


def score_counts(counts: DataFrame) -> DataFrame:
    n = c("citizen_report_count")
    return counts.withColumns({
        "citizen_risk_score": F.least(n * POINTS_PER_REPORT, F.lit(MAX_POINTS)).cast("double"),
        "citizen_anomaly": n > 0,
    })


def citizen_risk(reports: DataFrame) -> DataFrame:
    return score_counts(report_counts(reports))
