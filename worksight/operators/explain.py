"""Reasons in words, as one array expression per row (no UDF)."""

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import OUTLIER_FEATURES
from ..functions.columns import holds, round_even

c = F.col

# Sentences shown to the reader.
TEXT = {
    "financial_high": "Significant financial anomaly detected (financial risk: %.0f/100)",
    "financial_low": "Financial irregularity detected (financial risk: %.0f/100)",
    "delay_days": "Project is delayed by approximately %d days",
    "delay": "Project shows a delay/stalling signal",
    "progress_percent": "Financial and physical progress show a mismatch of approximately %.1f%%",
    "progress": "Financial and physical progress mismatch detected",
    "amount_mismatch": "Document amount does not match the project expenditure",
    "contractor_mismatch": "Contractor information differs between project and document records",
    "location_mismatch": "Project location differs from the document location",
    "missing_document": "Required project document is missing",
    "reused_image": "Potentially reused project image detected",
    "high_similarity": "Highly similar image detected (similarity: %.2f)",
    "missing_image": "Project does not have image evidence",
    "image": "Image evidence requires verification",
    "failed_inspection": "Latest inspection was marked as FAILED",
    "needs_improvement": "Inspection indicates that improvement is required",
    "low_inspection_score": "Low inspection score detected (%.0f/100)",
    "missing_inspection": "Inspection evidence is missing",
    "ml": "ML model (Isolation Forest) flags this project as a statistical outlier versus similar projects, "
          "driven mostly by %s (anomaly score: %.0f/100)",
    "ml_profile": "its overall profile",
    "duplicate": "Project name/type/location closely matches another project in the portfolio "
                 "(possible duplicate or re-registered work)",
    "citizen": "%d citizen report(s) filed against this project (unverified, but a corroborating signal)",
    "geo": "Project location overlaps with %d other unrelated project(s) within 300 m — possible duplicate site claim",
    "contractor_high": "Contractor shows elevated historical risk pattern (%.0f/100)",
    "contractor_medium": "Contractor shows moderate historical risk pattern (%.0f/100)",
    "none": "No significant anomaly signals detected",
}


def _say(key: str, *values: Column) -> Column:
    return F.format_string(TEXT[key], *values) if values else F.lit(TEXT[key])


def _whole(x: Column) -> Column:
    # format_string rounds half up; the sentences round half to even
    return F.rint(x)


def reason_slots(detail: bool = True) -> list[Column]:
    """One expression per possible sentence, NULL when it does not apply.

    ``detail`` words the delay, progress, document, image and inspection
    reasons from the evidence itself.  Without it only flag and score of each
    signal are known, and the wording falls back to the general sentence.
    """
    days = c("delay_days") if detail else F.lit(0)
    gap = c("progress_mismatch") if detail else F.lit(0.0)

    def found(name):
        return holds(c(name)) if detail else F.lit(False)

    fin, contractor = c("financial_risk_score"), c("contractor_risk_score")
    slots = [
        F.when(c("financial_anomaly"),
               F.when(fin >= 70, _say("financial_high", _whole(fin))).otherwise(_say("financial_low", _whole(fin)))),
        F.when(c("delay_anomaly"),
               F.when(holds(days > 0), _say("delay_days", days)).otherwise(_say("delay"))),
        F.when(c("progress_anomaly"),
               F.when(gap.isNotNull(), _say("progress_percent", round_even(F.abs(gap), 1)))
               .otherwise(_say("progress"))),
    ]
    slots += [F.when(c("document_anomaly") & found(n), _say(n)) for n in
              ("amount_mismatch", "contractor_mismatch", "location_mismatch", "missing_document")]
    similarity = round_even(c("similarity_score"), 2) if detail else F.lit(0.0)
    inspected = _whole(c("inspection_score")) if detail else F.lit(0.0)
    name = F.coalesce(c("ml_top_feature"), F.lit(""))
    labels = F.create_map(*[F.lit(x) for pair in OUTLIER_FEATURES.items() for x in pair])
    label = F.coalesce(F.try_element_at(labels, name), F.when(name != "", name), F.lit(TEXT["ml_profile"]))
    slots += [
        F.when(c("image_anomaly"),
               F.when(found("reused_image"), _say("reused_image"))
               .when(found("high_similarity"), _say("high_similarity", similarity))
               .when(found("missing_image"), _say("missing_image")).otherwise(_say("image"))),
        F.when(c("inspection_anomaly"),
               F.when(found("failed_inspection"), _say("failed_inspection"))
               .when(found("needs_improvement"), _say("needs_improvement"))
               .when(found("low_inspection_score"), _say("low_inspection_score", inspected))
               .when(found("missing_inspection"), _say("missing_inspection"))),
        F.when(c("ml_anomaly"), _say("ml", label, _whole(c("ml_anomaly_score")))),
        F.when(c("duplicate_anomaly"), _say("duplicate")),
        F.when(c("citizen_anomaly"), _say("citizen", c("citizen_report_count"))),
        F.when(c("geo_anomaly"), _say("geo", c("geo_overlap_count"))),
        F.when(contractor >= 70, _say("contractor_high", _whole(contractor)))
         .when(contractor >= 40, _say("contractor_medium", _whole(contractor))),
    ]
    return slots


def explain(risk: DataFrame, detail: bool = True) -> DataFrame:
    if "ml_top_feature" not in risk.columns:
        risk = risk.withColumn("ml_top_feature", F.lit(""))
    said = risk.withColumn("risk_reasons", F.array_compact(F.array(*reason_slots(detail))))
    return said.withColumn("risk_reasons", F.when(F.size("risk_reasons") == 0, F.array(_say("none")))
                           .otherwise(c("risk_reasons"))).withColumn("risk_reason_count", F.size("risk_reasons"))
