"""Submissions against a project list that changes while they arrive.

Projects are a stream of their own.  A report or decision whose project is
not known yet waits for it, at most ``wait`` of event time, and is rejected
after that.  This is a stream-stream left outer join: the state holds one row
for each project, for good, and the submissions that still wait.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import strip
from ..operators.reports import judge_decisions, judge_reports, normal_decisions, normal_reports

c = F.col


def _key(id, without: str):
    # Marked, not filtered: a filter would move below the watermark and hide rows without an id from the clock.
    return F.when(F.coalesce(id, F.lit("")) == "", F.lit(without)).otherwise(F.concat(F.lit("id:"), id))


def known_projects(projects: DataFrame, since: str = "registered_at", lateness: str = "1 hour") -> DataFrame:
    """_key, _since: each project once, by its first arrival.

    A row without a project id only moves the clock.
    """
    timed = projects.select(_key(strip(c("project_id").cast("string")), "clock").alias("_key"), c(since).cast("timestamp").alias("_since"))
    return timed.withWatermark("_since", lateness).dropDuplicates(["_key"])


def _waiting(rows: DataFrame, projects: DataFrame, event_time: str, since: str, wait: str, lateness: str) -> DataFrame:
    timed = rows.withColumn(event_time, F.coalesce(c(event_time).cast("timestamp"), F.current_timestamp()))
    known = known_projects(projects, since, lateness)
    in_time = c("_since") <= c(event_time) + F.expr(f"interval {wait}")
    return (timed.withWatermark(event_time, lateness).join(known, (_key(c("project_id"), "none") == c("_key")) & in_time, "left")
            .withColumn("_known", c("_key").isNotNull()).drop("_key", "_since"))


def waiting_reports(submissions: DataFrame, projects: DataFrame, wait: str = "7 days", lateness: str = "1 hour",
                    event_time: str = "submitted_at", since: str = "registered_at") -> DataFrame:
    """Checked reports with ``reject_reason``, as ``report_stream`` gives them.

    A report is released with its project, or at once if that is known, and
    rejected as "project not found" when event time has passed its own by
    ``wait``.  Event time is the slower of both streams, so an idle project
    list sends rows without an id.  Rows later than ``lateness`` are left out.
    """
    return judge_reports(_waiting(normal_reports(submissions), projects, event_time, since, wait, lateness))


def waiting_decisions(submissions: DataFrame, projects: DataFrame, wait: str = "7 days", lateness: str = "1 hour",
                      event_time: str = "verification_date", since: str = "registered_at") -> DataFrame:
    """Checked decisions; they wait as reports do."""
    return judge_decisions(_waiting(normal_decisions(submissions), projects, event_time, since, wait, lateness))
