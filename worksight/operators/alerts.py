"""Priorities, alerts and the reports read from the finished risk table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FLAG_COLUMN, SHARP_SIGNALS
from ..functions.columns import any_of, ladder, round_even
from ..plans.materialize import materialize
from ..plans.rank import global_rank
from .fusion import BASE_COLUMNS, RISK_STEPS

c = F.col

# Labels, and the words that decide the type of an alert.
PRIORITY = [(90, "P1 - IMMEDIATE"), (70, "P2 - HIGH PRIORITY"), (40, "P3 - MONITOR")]
ACTION = [(90, "Immediate human verification / field inspection"),
          (70, "Priority investigation by responsible authority"),
          (40, "Monitor project and review supporting evidence")]
LEVEL_ALERT = {"CRITICAL": "CRITICAL RISK ALERT", "HIGH": "HIGH RISK ALERT"}
WORD_ALERT = [
    (["financial"], "FINANCIAL ALERT"),
    (["delay"], "DELAY ALERT"),
    (["document"], "DOCUMENT ALERT"),
    (["inspection"], "INSPECTION ALERT"),
    (["image"], "IMAGE EVIDENCE ALERT"),
    (["ml model", "isolation forest"], "ML ANOMALY ALERT"),
    (["duplicate", "re-registered"], "DUPLICATE PROJECT ALERT"),
    (["location overlaps"], "GEO-SPATIAL OVERLAP ALERT"),
    (["citizen report"], "CITIZEN REPORTED ALERT"),
]
FLAG_ALERT = [("financial", "FINANCIAL ALERT"), ("delay", "DELAY ALERT"), ("document", "DOCUMENT ALERT"),
              ("inspection", "INSPECTION ALERT"), ("image", "IMAGE EVIDENCE ALERT"),
              ("ml_anomaly", "ML ANOMALY ALERT"), ("duplicate", "DUPLICATE PROJECT ALERT"),
              ("geo", "GEO-SPATIAL OVERLAP ALERT"), ("citizen", "CITIZEN REPORTED ALERT")]
GENERAL_ALERT = "GENERAL REVIEW ALERT"


def rank_order() -> list[Column]:
    return [c("overall_risk_score").desc(), c("risk_signal_count").desc(), c("project_id").asc()]


def _by_level_then(steps: list[tuple[Column, str]]) -> Column:
    out = F.when(c("risk_level") == "CRITICAL", LEVEL_ALERT["CRITICAL"]).when(
        c("risk_level") == "HIGH", LEVEL_ALERT["HIGH"])
    for cond, label in steps:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(GENERAL_ALERT))


def _mentions(words: Sequence[str]) -> Column:
    return F.exists("risk_reasons", lambda r: any_of(*[F.contains(F.lower(r), F.lit(w)) for w in words]))


def add_alerts(explained: DataFrame) -> DataFrame:
    """``alert_type`` follows the wording of the reasons (a sentence on progress
    mentions finances and is typed FINANCIAL); ``alert_type_by_flag`` follows
    the signals themselves."""
    score = c("overall_risk_score")
    some = c("risk_signal_count") > 0
    return explained.withColumns({
        "priority": ladder(score, PRIORITY, F.when(some, "P4 - REVIEW").otherwise("P5 - NORMAL")),
        "recommended_action": ladder(score, ACTION, F.when(some, "Routine verification recommended")
                                     .otherwise("No immediate action required")),
        "alert_type": _by_level_then([(_mentions(words), label) for words, label in WORD_ALERT]),
        "alert_type_by_flag": _by_level_then([(c(FLAG_COLUMN[s]), label) for s, label in FLAG_ALERT]),
        "sharp_signal_fired": any_of(*[c(FLAG_COLUMN[s]) for s in SHARP_SIGNALS]),
    }).withColumns({
        "alert_required": (score >= 40) | c("sharp_signal_fired"),
        "alert_severity": ladder(score, RISK_STEPS, F.when(c("sharp_signal_fired"), "MEDIUM").otherwise("NONE")),
    })


RANK_KEYS = ["project_id", "overall_risk_score", "risk_signal_count"]


def investigation_rank(alerts: DataFrame, carry: Sequence[str] | None = None) -> DataFrame:
    """1..n over the whole table; ties go by project id.

    Ranking writes its rows twice.  ``carry`` names the columns to take along
    beside the three that decide the rank (default: all of the table).
    """
    narrow = alerts if carry is None else alerts.select(*dict.fromkeys([*RANK_KEYS, *carry]))
    return global_rank(narrow, rank_order(), "investigation_rank")


# --- reports on the finished table -------------------------------------------

HIGH_RISK_COLUMNS = ["project_id", "project_name", "state", "district", "mp_name", "contractor",
                     "overall_risk_score", "risk_level", "risk_signal_count", "priority", "alert_severity",
                     "recommended_action"]
ALERT_COLUMNS = ["project_id", "project_name", "district", "overall_risk_score", "risk_level", "alert_type",
                 "alert_severity", "priority", "recommended_action", "risk_reasons"]
MAP_COLUMNS = ["overall_risk_score", "risk_level", "risk_signal_count", "geo_anomaly"]
DETAIL_COLUMNS = [*BASE_COLUMNS[:13], "overall_risk_score", "risk_level", "risk_signal_count", "priority",
                  "financial_risk_score", "delay_risk_score", "progress_risk_score", "contractor_risk_score",
                  "document_risk_score", "image_risk_score", "inspection_risk_score", "ml_anomaly_score",
                  "duplicate_risk_score", "geo_risk_score", "geo_overlap_count", "citizen_risk_score",
                  "citizen_report_count", "latitude", "longitude", "recommended_action", "risk_reasons"]
SEARCHED = ["project_id", "project_name", "district", "mp_name", "contractor"]


def mean_score(column: str = "overall_risk_score") -> Column:
    """Mean of two-decimal scores from a sum of whole hundredths, which does
    not depend on the order of addition."""
    hundredths = F.sum(F.rint(c(column) * 100).cast("bigint"))
    return round_even(F.try_divide(hundredths.cast("double"), F.count(column)) / 100, 2)


def risk_summary(alerts: DataFrame) -> DataFrame:
    levels = {"low_risk": "LOW", "medium_risk": "MEDIUM", "high_risk": "HIGH", "critical_risk": "CRITICAL"}
    return alerts.agg(
        F.count("*").alias("total_projects"),
        *[F.count_if(c("risk_level") == level).alias(name) for name, level in levels.items()],
        F.count_if("alert_required").alias("total_alerts"), mean_score().alias("average_risk_score"))


def high_risk(alerts: DataFrame) -> DataFrame:
    return _listed(alerts.where(c("risk_level").isin("HIGH", "CRITICAL")), HIGH_RISK_COLUMNS)


def _listed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in rank order.  A sort samples its input first; the rows are written, so that this reads a file and
    does not join and weigh all signals a second time."""
    return materialize(rows.select(*dict.fromkeys([*columns, *RANK_KEYS])), "to-list").orderBy(*rank_order()).select(*columns)


def alert_feed(alerts: DataFrame) -> DataFrame:
    return _listed(alerts.where("alert_required"), ALERT_COLUMNS)


def map_projects(projects: DataFrame, alerts: DataFrame) -> DataFrame:
    places = projects.where(c("latitude").isNotNull() & c("longitude").isNotNull()).select(
        "project_id", "project_name", "state", "district", "latitude", "longitude")
    return places.join(alerts.select("project_id", *MAP_COLUMNS), "project_id", "left")


def project_detail(alerts: DataFrame, project_id: str) -> DataFrame:
    return alerts.where(c("project_id") == project_id.strip()).select(*DETAIL_COLUMNS)


def search_projects(alerts: DataFrame, text: str = "", level: str = "ALL",
                    limit: int | None = 200) -> DataFrame:
    """Matches in rank order; the text may stand in any searched column.  The
    default limit is the length of a screen; ``None`` returns every match."""
    found = alerts if level == "ALL" else alerts.where(c("risk_level") == level)
    query = text.strip().lower()
    if query:
        found = found.where(any_of(*[F.contains(F.lower(x), F.lit(query)) for x in SEARCHED]))
    ranked = found.orderBy(*rank_order())
    return ranked if limit is None else ranked.limit(limit)


# --- reports of single signals -----------------------------------------------

def top_k(df: DataFrame, score: str, columns: Sequence[str], k: int = 20, flag: str | None = None,
          tie: str = "project_id") -> DataFrame:
    rows = df if flag is None else df.where(flag)
    return rows.orderBy(c(score).desc(), c(tie).asc()).select(*columns).limit(k)


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row: number of rows and how often each flag is set."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(c(x)).alias(x) for x in flags])
