"""The whole analysis as one lazy plan."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import alerts as A
from ..operators.contractors import contractor_scores
from ..operators.duplicates import duplicate_hits
from ..operators.evidence import (DOCUMENT_FLAGS, IMAGE_FLAGS, INSPECTION_FLAGS, document_rollup, image_rollup,
                                  inspection_rollup)
from ..operators.explain import explain
from ..operators.features import add_features
from ..operators.fusion import BASE_COLUMNS, fuse, join_signals, signal_availability
from ..operators.outliers import ml_outliers
from ..operators.proximity import geo_hits
from ..operators.reports import citizen_risk
from ..operators.rules import row_rules
from ..sources.readers import Dataset
from .materialize import materialize

c = F.col
ROW_SIGNALS = [f"{s}_{x}" for s in ("financial", "delay", "progress") for x in ("anomaly", "risk_score")]
DETAIL = ["delay_days", "progress_mismatch"]
# A project without any row in an evidence table scores as "missing".
ABSENT = {"document": (30.0, "missing_document", DOCUMENT_FLAGS), "image": (30.0, "missing_image", IMAGE_FLAGS),
          "inspection": (30.0, "missing_inspection", INSPECTION_FLAGS)}


@dataclass
class Assessment:
    """The risk table and which signals took part."""
    risk: DataFrame
    availability: dict[str, bool]

    def stored(self, *columns: str) -> "Assessment":
        """Write the table once when several reports will read it; ``columns`` are those that they read (default: all)."""
        return Assessment(materialize(self.risk.select(*columns) if columns else self.risk, "risk"), self.availability)


def _together(spark: SparkSession, builders: list) -> list:
    """Build independent signals side by side.  Some run jobs while they are
    planned, and one such job alone rarely fills a cluster."""
    carry = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=len(builders)) as pool:
        return [f.result() for f in [pool.submit(carry(b)) for b in builders]]


def repeated_ids(projects: DataFrame) -> DataFrame:
    """Project ids on more than one row, and on how many."""
    return projects.groupBy("project_id").agg(F.count("*").alias("rows")).where(c("rows") > 1)


def _one_per_project(signal: DataFrame) -> DataFrame:
    """The highest row of each project id, compared column by column."""
    columns = [x for x in signal.columns if x != "project_id"]
    best = signal.groupBy("project_id").agg(F.max(F.struct(*columns)).alias("best"))
    return best.select("project_id", "best.*")


def evidence_signals(data: Dataset) -> dict[str, list[Callable[[], DataFrame]]]:
    """Rollups of each kind of evidence.  Where a kind has several, its signal is the highest value of each column."""
    found = {}
    if data.documents is not None:
        found["document"] = [lambda: document_rollup(data.projects, data.documents)]
    if data.images is not None:
        found["image"] = [lambda: image_rollup(data.images)]
    if data.inspections is not None:
        found["inspection"] = [lambda: inspection_rollup(data.inspections)]
    if data.citizen_reports is not None:
        found["citizen"] = [lambda: citizen_risk(data.citizen_reports)]
    return found


def _with_highest(joined: DataFrame, more: DataFrame) -> DataFrame:
    """A further rollup of a signal that is joined already."""
    names = [x for x in more.columns if x != "project_id"]
    side = more.select("project_id", *[c(x).alias(f"_{x}") for x in names])
    return (joined.join(side, "project_id", "left").withColumns({x: F.greatest(c(x), c(f"_{x}")) for x in names})
            .drop(*side.columns[1:]))


def risk_fusion(data: Dataset, as_of: Column | None = None, include_ml: bool = True) -> Assessment:
    """One row per project with all signals and the overall score.

    The projects are written once, unless they are ``stored``, so a source
    that must be parsed is read once and each signal reads the few columns it needs.  Project ids should
    be unique; the rows of a repeated one are all kept, and share the highest
    values of the signals that are joined by id.
    """
    if not data.stored:
        data = replace(data, projects=materialize(data.projects, "projects"), stored=True)
    return fuse_signals(data, evidence_signals(data), as_of, include_ml)


def fuse_signals(data: Dataset, evidence: dict[str, list[Callable[[], DataFrame]]], as_of: Column | None = None,
                 include_ml: bool = True) -> Assessment:
    """``risk_fusion`` of stored projects with the given rollups of the evidence."""
    unique = repeated_ids(data.projects).isEmpty()
    features = add_features(data.projects, as_of)
    base = row_rules(features).select(*BASE_COLUMNS, *ROW_SIGNALS, *DETAIL)

    builders = [lambda: contractor_scores(features)]
    builders += [b for several in evidence.values() for b in several[:1]]
    if data.availability.get("project_name"):
        builders.append(lambda: duplicate_hits(data.projects).drop("duplicate_match_score"))
    if data.availability.get("latitude") and data.availability.get("longitude"):
        builders.append(lambda: geo_hits(data.projects).drop("geo_nearest_km"))
    if include_ml:
        builders.append(lambda: ml_outliers(features))
    further = [b for several in evidence.values() for b in several[1:]]
    signals, ml_fitted = _together(data.projects.sparkSession, builders), False
    if include_ml:
        scores, ml_fitted = signals.pop()
        signals.append(scores.drop("ml_signal_available"))

    joined = join_signals(base, signals if unique else [_one_per_project(s) for s in signals])
    for build in further:
        joined = _with_highest(joined, build() if unique else _one_per_project(build()))
    filled = {}
    for kind, (score, missing, flags) in ABSENT.items():
        if kind not in evidence:
            filled |= {n: F.lit(False) for n in flags}
            continue
        absent = c(f"{kind}_risk_score").isNull()
        filled[f"{kind}_risk_score"] = F.coalesce(c(f"{kind}_risk_score"), F.lit(score))
        filled[f"{kind}_anomaly"] = F.coalesce(c(f"{kind}_anomaly"), F.lit(True))
        filled |= {n: F.when(absent, F.lit(n == missing)).otherwise(c(n)) for n in flags}
    if data.images is None:
        filled["similarity_score"] = F.lit(0.0)
    if data.inspections is None:
        filled["inspection_score"] = F.lit(None).cast("double")
    available = signal_availability(data.availability, data.files, ml_fitted)
    return Assessment(fuse(joined.withColumns(filled), available), available)


def assess(data: Dataset, as_of: Column | None = None, include_ml: bool = True,
           evidence: str = "full") -> Assessment:
    """Fusion, reasons and alerts.

    ``evidence="full"`` words the reasons from the evidence; ``"summary"``
    knows only flag and score of each signal.
    """
    return with_reasons(risk_fusion(data, as_of, include_ml), evidence)


def with_reasons(fused: Assessment, evidence: str = "full") -> Assessment:
    """Reasons and alerts of a fused table."""
    return Assessment(A.add_alerts(explain(fused.risk, evidence == "full")), fused.availability)
