"""Join all signals to one row per project and weigh them."""

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from ..constants import FLAG_COLUMN, SCORE_COLUMN, SIGNAL_INPUTS, SIGNAL_WEIGHTS
from ..functions.columns import holds, ladder, round_even
from ..sources.readers import Dataset

c = F.col

BASE_COLUMNS = ["project_id", "project_name", "state", "district", "mp_name", "project_type", "contractor",
                "agency", "status", "sanctioned_amount", "released_amount", "utilized_amount",
                "completion_percentage", "latitude", "longitude"]
RISK_STEPS = [(90, "CRITICAL"), (70, "HIGH"), (40, "MEDIUM")]
# These three come from the project row itself and keep their flag even when
# the column they need was defaulted.
ALWAYS_FLAGGED = ("financial", "delay", "progress")
COUNTS = ["citizen_report_count", "geo_overlap_count"]


def signal_availability(columns: dict[str, bool], files: dict[str, bool], ml_fitted: bool) -> dict[str, bool]:
    """Which signals this portfolio can support at all (metadata only)."""
    has = columns.get
    return {
        "financial": any(has(x, False) for x in SIGNAL_INPUTS["financial"]),
        "delay": all(has(x, False) for x in SIGNAL_INPUTS["delay"]),
        "progress": all(has(x, False) for x in SIGNAL_INPUTS["progress"]),
        "contractor": has("contractor", False),
        "document": files.get("documents", False),
        "image": files.get("images", False),
        "inspection": files.get("inspections", False),
        "ml_anomaly": ml_fitted,
        "duplicate": has("project_name", False),
        "geo": all(has(x, False) for x in SIGNAL_INPUTS["geo"]),
        "citizen": True,
    }


def effective_weights(available: dict[str, bool]) -> dict[str, float]:
    """Weights of the available signals, rescaled to a sum of 1."""
    total = sum(w for s, w in SIGNAL_WEIGHTS.items() if available[s])
    total = total if total > 0 else 1.0
    return {s: (w / total if available[s] else 0.0) for s, w in SIGNAL_WEIGHTS.items()}


def join_signals(base: DataFrame, signals: list[DataFrame]) -> DataFrame:
    """Left joins on the project id.  Every signal has at most one row per
    project and is already partitioned by it, so the wide table is shuffled
    once, for the first join."""
    return reduce(lambda left, right: left.join(right, "project_id", "left"), signals, base)


def fuse(joined: DataFrame, available: dict[str, bool]) -> DataFrame:
    """Overall score, level and number of signals."""
    missing = {n: F.lit(0.0) for n in SCORE_COLUMN.values() if n not in joined.columns}
    missing |= {n: F.lit(False) for n in FLAG_COLUMN.values() if n not in joined.columns}
    missing |= {n: F.lit(0) for n in COUNTS if n not in joined.columns}
    df = joined.withColumns(missing) if missing else joined
    filled = {n: F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in SCORE_COLUMN.values()}
    filled |= {n: F.coalesce(c(n), F.lit(0)).cast("bigint") for n in COUNTS}
    filled |= {n: holds(c(n)) if available[s] or s in ALWAYS_FLAGGED else F.lit(False)
               for s, n in FLAG_COLUMN.items()}
    df = df.withColumns(filled)
    terms = [c(SCORE_COLUMN[s]) * F.lit(w) for s, w in effective_weights(available).items() if w > 0]
    total = reduce(add, terms, F.lit(0.0))
    df = df.withColumn("overall_risk_score", round_even(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2))
    return df.withColumns({
        "risk_level": ladder(c("overall_risk_score"), RISK_STEPS, "LOW"),
        "risk_signal_count": reduce(add, [c(n).cast("int") for n in FLAG_COLUMN.values()]),
    })


def data_readiness(data: Dataset, ml_fitted: bool) -> DataFrame:
    """One row per signal: what it needs, whether the columns and files allow
    it, and whether it takes part in the overall score."""
    active = signal_availability(data.availability, data.files, ml_fitted)
    by_columns = {**active, "ml_anomaly": all(
        data.availability.get(x, False) for x in ("completion_percentage", "sanctioned_amount"))}
    weights = effective_weights(active)
    rows = [(s, SIGNAL_INPUTS[s], by_columns[s], active[s], weights[s]) for s in SIGNAL_WEIGHTS]
    return data.projects.sparkSession.createDataFrame(
        rows, "signal string, requires array<string>, available boolean, active boolean, effective_weight double")


def readiness_totals(readiness: DataFrame) -> DataFrame:
    """How many signals the columns and files allow, of how many."""
    return readiness.agg(F.count_if("available").alias("signals_available"), F.count("*").alias("signals_total"))


def data_inventory(data: Dataset) -> DataFrame:
    """Files and project columns: supplied by the source or filled in."""
    rows = [("file", n, there) for n, there in data.files.items()]
    rows += [("column", n, there) for n, there in data.availability.items()]
    return data.projects.sparkSession.createDataFrame(rows, "kind string, name string, supplied boolean")
