"""Derived project columns (row-local)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import floor_days


def add_features(projects: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Ratios, progress gap and durations.

    Open projects are measured up to ``as_of`` (default: today), which is a
    parameter so that a report can be repeated later.
    """
    today = (F.current_date() if as_of is None else as_of).cast("timestamp")
    c = F.col
    step1 = projects.withColumns({
        "utilization_percentage": F.try_divide(c("utilized_amount"), c("sanctioned_amount")) * F.lit(100.0),
        "financial_progress_percentage": c("financial_progress_ratio") * F.lit(100.0),
        "end_date_for_calculation": F.coalesce(c("actual_completion_date").cast("timestamp"), today),
        "planned_duration_days": floor_days(c("expected_completion_date"), c("start_date")),
        "missing_actual_completion": c("actual_completion_date").isNull(),
    })
    gap = c("financial_progress_percentage") - c("completion_percentage")
    late = floor_days(c("end_date_for_calculation"), c("expected_completion_date"))
    return step1.withColumns({
        "progress_mismatch": gap,
        "progress_mismatch_abs": F.abs(gap),
        "actual_duration_days": floor_days(c("end_date_for_calculation"), c("start_date")),
        # greatest() would turn a missing delay into 0
        "delay_days": F.when(late.isNotNull(), F.greatest(late, F.lit(0))),
    })
