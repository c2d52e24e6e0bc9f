"""Threshold rules over one project row: financial, delay, progress.

Each adds ``<signal>_anomaly`` and ``<signal>_risk_score`` without a shuffle.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import any_of, holds, points

c = F.col


def financial_rules(features: DataFrame) -> DataFrame:
    sanctioned, released, utilized = c("sanctioned_amount"), c("released_amount"), c("utilized_amount")
    overspent = utilized > sanctioned
    overreleased = released > sanctioned
    gap = c("progress_mismatch_abs") > 30
    unpaid_work = (utilized <= 0) & (c("completion_percentage") > 0)
    # a release against nothing sanctioned is an infinite share
    upfront = (F.try_divide(released, sanctioned) >= F.lit(0.99).cast("double")) | ((sanctioned == 0) & (released > 0))
    return features.withColumns({
        "financial_anomaly": any_of(overspent, overreleased, gap, unpaid_work, upfront),
        "financial_risk_score": points(
            (overspent, 40), (overreleased, 30), (c("utilization_percentage") > 95, 15),
            (gap, 25), (unpaid_work, 20), (upfront, 40)),
    })


def delay_rules(features: DataFrame) -> DataFrame:
    """The recorded status decides; day counts only raise the score."""
    late = holds(F.lower(c("status")) == "delayed")
    overrun = c("actual_duration_days") > c("planned_duration_days") * F.lit(1.5).cast("double")
    return features.withColumns({
        "delay_anomaly": late,
        "delay_risk_score": points(
            (late, 60), (late & (c("delay_days") > 90), 15),
            (late & (c("delay_days") > 180), 15), (late & overrun, 10)),
    })


def progress_rules(features: DataFrame) -> DataFrame:
    gap = c("progress_mismatch")
    ahead, apart = gap > 20, c("progress_mismatch_abs") > 50
    paid_not_built = (c("utilization_percentage") > 80) & (c("completion_percentage") < 50)
    return features.withColumns({
        "progress_anomaly": any_of(ahead, apart, paid_not_built),
        "progress_risk_score": points((ahead, 40), (gap > 40, 25), (apart, 20), (paid_not_built, 30)),
    })


def row_rules(features: DataFrame) -> DataFrame:
    return progress_rules(delay_rules(financial_rules(features)))
