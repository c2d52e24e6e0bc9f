"""Check documents, images and inspections against the project records.

Every check has two forms.  ``verify_*`` lists one row per piece of evidence
plus one row per project that has none.  ``*_rollup`` reduces to one row per
project for the overall score: highest score, any flag.

The evidence table may be very uneven (one project with a third of all
files), so projects are never the left side of an outer join against it:
matched rows come from an inner join that salts crowded projects, and the
rollup combines inside each task before its shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of, holds, normal_text, not_blank, points
from ..plans.materialize import materialize
from ..plans.skew import LOOKUP_ROWS_PER_TASK, lookup_join

c = F.col

EMPTY_HASH_PARTS = 4096         # parts into which the images without a hash are dealt

DOCUMENT_FLAGS = ["amount_mismatch", "contractor_mismatch", "location_mismatch", "missing_document"]
IMAGE_FLAGS = ["missing_image", "reused_image", "high_similarity", "potentially_reused"]
INSPECTION_FLAGS = ["missing_inspection", "failed_inspection", "needs_improvement", "low_inspection_score"]


def _with_absent(matched: DataFrame, projects: DataFrame, evidence: DataFrame, fixed: dict[str, Column]) -> DataFrame:
    """Add one row for each project without evidence."""
    present = evidence.select("project_id").distinct()
    absent = projects.join(present, "project_id", "left_anti")
    columns = [fixed.get(f.name, c(f.name) if f.name in absent.columns else F.lit(None).cast(f.dataType))
               .alias(f.name) for f in matched.schema.fields]
    return matched.unionByName(absent.select(*columns))


def _flags(true_names, names, prefix, score):
    fixed = {n: F.lit(n in true_names) for n in names}
    return {**fixed, f"{prefix}_exists": F.lit(False), f"{prefix}_anomaly": F.lit(True),
            f"{prefix}_risk_score": F.lit(float(score)), f"{prefix}_signal_available": F.lit(True)}


def _unavailable(projects: DataFrame, names, prefix) -> DataFrame:
    """No such file for this portfolio: nothing can be said, nothing is flagged."""
    off = {n: F.lit(False) for n in [f"{prefix}_exists", *names, f"{prefix}_anomaly", f"{prefix}_signal_available"]}
    return projects.withColumns({**off, f"{prefix}_risk_score": F.lit(0.0)})


def _rollup(checked: DataFrame, names, prefix, extra: list[Column] = ()) -> DataFrame:
    return checked.groupBy("project_id").agg(
        *[F.bool_or(n).alias(n) for n in [*names, f"{prefix}_anomaly"]],
        F.max(f"{prefix}_risk_score").alias(f"{prefix}_risk_score"), *extra)


# --- documents --------------------------------------------------------------

def _check_documents(projects: DataFrame, documents: DataFrame, rows_per_task: int | None) -> DataFrame:
    """``rows_per_task``: salt crowded projects, for a grouping by project that follows; None leaves the join as it is."""
    files = documents.select(
        "project_id", "document_id", "amount", c("contractor").alias("document_contractor"),
        c("location").alias("document_location"))
    known = projects.select("project_id", "project_name", "district", "contractor", "utilized_amount")
    rows = (files.join(known, "project_id") if rows_per_task is None
            else lookup_join(files, known, "project_id", "document_id", rows_per_task))
    # White space at the ends of a location does not change what it contains, and equal names need no cleaning.
    district, location = normal_text(c("district")), F.lower(F.coalesce(c("document_location"), F.lit("")))
    names = c("contractor"), c("document_contractor")
    other_name = (F.coalesce(names[0], F.lit("")) != F.coalesce(names[1], F.lit(""))) & (normal_text(names[0]) != normal_text(names[1]))
    exists = c("document_id").isNotNull()
    rows = rows.withColumns({
        "document_exists": exists,
        "amount_mismatch": holds(exists & (F.abs(c("amount") - c("utilized_amount")) > 1)),
        "contractor_mismatch": exists & other_name,
        "location_mismatch": exists & ~F.contains(location, district) & (district != "") & not_blank(location),
        "missing_document": ~exists,
    })
    return rows.withColumns({
        "document_anomaly": any_of(*[c(n) for n in DOCUMENT_FLAGS]),
        "document_risk_score": points(
            (c("amount_mismatch"), 40), (c("contractor_mismatch"), 30),
            (c("location_mismatch"), 20), (c("missing_document"), 30)),
        "document_signal_available": F.lit(True),
    })


def verify_documents(projects: DataFrame, documents: DataFrame | None, rows_per_task: int | None = None) -> DataFrame:
    if documents is None:
        return _unavailable(projects, DOCUMENT_FLAGS, "document")
    return _with_absent(_check_documents(projects, documents, rows_per_task), projects, documents,
                        _flags({"missing_document"}, DOCUMENT_FLAGS, "document", 30))


def document_rollup(projects: DataFrame, documents: DataFrame,
                    rows_per_task: int | None = LOOKUP_ROWS_PER_TASK) -> DataFrame:
    return _rollup(_check_documents(projects, documents, rows_per_task), DOCUMENT_FLAGS, "document")


# --- images -----------------------------------------------------------------

def image_hash_reuse(images: DataFrame, count_empty: bool = False) -> DataFrame:
    """Hashes seen on more than one image.

    Images without a hash are not copies of each other; ``count_empty``
    treats the empty text as a hash like any other.
    """
    hashed = images if count_empty else images.where(c("image_hash") != "")
    return hashed.groupBy("image_hash").agg(F.count("*").alias("uses")).where(c("uses") > 1)


def _stored_reuse(images: DataFrame, count_empty: bool) -> DataFrame:
    """``image_hash_reuse``, written, so that a join knows its size and sends few reused hashes to the images.

    Most hashes are seen once.  Numbers of 64 bits are counted first, and only hashes whose number is seen twice
    are counted as text, so the others never move.
    """
    coded = images.select("image_hash", F.xxhash64("image_hash").alias("_code")).where(
        c("image_hash").isNotNull() if count_empty else c("image_hash") != "")
    codes = materialize(coded.groupBy("_code").agg(F.count("*").alias("n")).where(c("n") > 1).select("_code"), "hash-codes")
    return materialize(image_hash_reuse(coded.join(codes, "_code", "left_semi"), count_empty), "reused-hashes")


def _check_images(images: DataFrame, count_empty: bool) -> DataFrame:
    reuse = _stored_reuse(images, count_empty)
    # Images without a hash all have the same one; the join deals them out by id.
    without = (F.coalesce(c("image_hash"), F.lit("")) == "") & F.lit(not count_empty)
    part = F.when(without, F.pmod(F.xxhash64("project_id", "image_id"), F.lit(EMPTY_HASH_PARTS))).otherwise(F.lit(0))
    rows = (images.select("project_id", "image_id", "image_hash", "similarity_score",
                          c("status").alias("image_status"), part.cast("int").alias("_part"))
            .join(reuse.withColumn("_part", F.lit(0)), ["image_hash", "_part"], "left").drop("_part"))
    return _judge_images(rows)


def _judge_images(rows: DataFrame) -> DataFrame:
    """Flags and points of image rows with the ``uses`` of their hash (null: not reused)."""
    exists = c("image_id").isNotNull()
    rows = rows.withColumn("similarity_score", F.coalesce(c("similarity_score"), F.lit(0.0))).withColumns({
        "image_exists": exists,
        "missing_image": ~exists,
        "reused_image": exists & c("uses").isNotNull(),
        "high_similarity": c("similarity_score") >= F.lit(0.90).cast("double"),
        "potentially_reused": F.contains(F.lower(F.coalesce(c("image_status"), F.lit(""))), F.lit("reused")),
    }).drop("uses")
    return rows.withColumns({
        "image_anomaly": any_of(*[c(n) for n in IMAGE_FLAGS]),
        "image_risk_score": points(
            (c("missing_image"), 30), (c("reused_image"), 50),
            (c("high_similarity"), 30), (c("potentially_reused"), 20)),
        "image_signal_available": F.lit(True),
    })


def verify_images(projects: DataFrame, images: DataFrame | None, count_empty: bool = False) -> DataFrame:
    if images is None:
        return _unavailable(projects, IMAGE_FLAGS, "image")
    # Nothing groups by project after this join, so adaptive execution splits a crowded project.
    checked = _check_images(images, count_empty).join(projects.select("project_id", "project_name"), "project_id")
    fixed = _flags({"missing_image"}, IMAGE_FLAGS, "image", 30)
    return _with_absent(checked, projects, images, {**fixed, "similarity_score": F.lit(0.0)})


def _image_rollup(checked: DataFrame) -> DataFrame:
    return _rollup(checked, IMAGE_FLAGS, "image", [F.max("similarity_score").alias("similarity_score")])


def image_rollup(images: DataFrame, count_empty: bool = False) -> DataFrame:
    return _image_rollup(_check_images(images, count_empty))


def image_rollups_in_place(parts: list[DataFrame], count_empty: bool = False) -> list[DataFrame]:
    """Rollups whose highest values are ``image_rollup`` of all ``parts``: each part as if no hash were reused, where
    its rows lie, and the rows with a reused hash, the only ones that move.  Reuse only adds points and flags."""
    columns = [c("project_id"), c("image_id"), c("image_hash"), c("similarity_score"), c("status").alias("image_status")]
    rows = [p.select(*columns) for p in parts]
    plain = [_image_rollup(_judge_images(r.withColumn("uses", F.lit(None).cast("long")))) for r in rows]
    every = reduce(DataFrame.unionByName, rows)
    hashed = every if count_empty else every.where(c("image_hash") != "")
    return [*plain, _image_rollup(_judge_images(hashed.join(image_hash_reuse(hashed, count_empty), "image_hash")))]


# --- inspections ------------------------------------------------------------

def _check_inspections(inspections: DataFrame) -> DataFrame:
    exists, status = c("inspection_id").isNotNull(), F.lower(F.coalesce(c("inspection_status"), F.lit("")))
    rows = inspections.select("project_id", "inspection_id", "inspection_score", "inspection_status").withColumns({
        "inspection_exists": exists,
        "missing_inspection": ~exists,
        "failed_inspection": status == "failed",
        "needs_improvement": status == "needs improvement",
        "low_inspection_score": holds(c("inspection_score") < 50),
    })
    return rows.withColumns({
        "inspection_anomaly": any_of(*[c(n) for n in INSPECTION_FLAGS]),
        "inspection_risk_score": points(
            (c("missing_inspection"), 30), (c("failed_inspection"), 50),
            (c("needs_improvement"), 25), (c("low_inspection_score"), 30)),
        "inspection_signal_available": F.lit(True),
    })


def analyze_inspections(projects: DataFrame, inspections: DataFrame | None) -> DataFrame:
    if inspections is None:
        return _unavailable(projects, INSPECTION_FLAGS, "inspection").withColumn("inspection_score", F.lit(0.0))
    checked = _check_inspections(inspections).join(projects.select("project_id", "project_name"), "project_id")
    return _with_absent(checked, projects, inspections,
                        _flags({"missing_inspection"}, INSPECTION_FLAGS, "inspection", 30))


def inspection_rollup(inspections: DataFrame) -> DataFrame:
    return _rollup(_check_inspections(inspections), INSPECTION_FLAGS, "inspection",
                   [F.min("inspection_score").alias("inspection_score")])
