"""Every query of the engine over the driver's test tables, with its oracle."""

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import constants as K
from ..operators import alerts as A, contractors, duplicates, evidence, insights, outliers, proximity, reports, rules
from ..operators.features import add_features
from ..operators.fusion import data_inventory, data_readiness, readiness_totals
from ..plans.colocated import ColocatedStore
from ..plans.materialize import materialize, scratch_dir
from ..plans.pipeline import assess, risk_fusion
from ..plans.serving import RiskStore
from ..sources.readers import find_table, load_dataset, load_projects
from ..sources.schema import DOCUMENTS, IMAGES, INSPECTIONS, PROJECTS, normalize, rejected_rows
from ..sources.sinks import to_records
from ..streaming import intake, refresh
from ..streaming.waiting import waiting_reports
from . import bindings as B
from .oracle import BODY, FLAGS, SCORES, compose, even, pct, text, weights_without

c = F.col
ML_REPORT = ["ml_anomaly_score", "ml_top_feature", "ml_top_feature_z"]
SEARCH, LEVEL, LOOKUP = "widget", "MEDIUM", "P4"

FEATURE_COLUMNS = ["project_id", "utilization_percentage", "financial_progress_percentage", "progress_mismatch",
                   "progress_mismatch_abs", "planned_duration_days", "actual_duration_days", "delay_days",
                   "missing_actual_completion"]
FUSED_COLUMNS = ["project_id", *SCORES, *FLAGS, "citizen_report_count", "geo_overlap_count", "overall_risk_score",
                 "risk_level", "risk_signal_count"]
DOC_ROW = ["project_id", "document_id", "document_exists", *evidence.DOCUMENT_FLAGS, "document_anomaly",
           "document_risk_score"]
IMG_ROW = ["project_id", "image_id", "image_exists", "similarity_score", *evidence.IMAGE_FLAGS, "image_anomaly",
           "image_risk_score"]
INS_ROW = ["project_id", "inspection_id", "inspection_exists", "inspection_score", *evidence.INSPECTION_FLAGS,
           "inspection_anomaly", "inspection_risk_score"]
STAMP, SQL_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS", "'%Y-%m-%d %H:%M:%S.%f'"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines report the same types."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[c(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else c(f.name)
                       for f in df.schema.fields])


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.rint(c(n) * 10.0 ** digits) / 10.0 ** digits for n in names})


def joined_reasons(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_reasons", F.array_join("risk_reasons", " | "))


def _features(spark, sf):
    return add_features(B.projects(spark, sf), B.as_of())


def _stored_features(spark, sf):
    return add_features(B.dataset(spark, sf).projects, B.as_of())


def _alerts(spark, sf, evidence_mode="full"):
    return assess(B.dataset(spark, sf), B.as_of(), include_ml=False, evidence=evidence_mode).risk


def _evidence(spark, sf, kind):
    name, spec = {"documents": ("evidence_documents", DOCUMENTS), "images": ("evidence_images", IMAGES),
                  "inspections": ("inspections", INSPECTIONS)}[kind]
    return normalize(B.view(spark, sf, name), spec)[0]


def _documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", "text", "lang"), duplicates.project_text("text", "lang")


# --- queries that need more than one line --------------------------------------

MESSY = {"project_id": "Proj ID", "project_name": "Work Name", "state": "STATE_UT", "district": "District Name",
         "mp_name": "Member of Parliament", "project_type": "Scheme Type", "contractor": " vendor ",
         "agency": "Nodal-Agency", "status": "work_status", "sanctioned_amount": "sanctionned_amount",
         "released_amount": "Amount Released", "utilized_amount": "utilised_amount",
         "completion_percentage": "Physical Progress", "financial_progress_ratio": "financial progres ratio",
         "latitude": "Lat", "longitude": "lng", "sanction_date": "approval_date",
         "start_date": "Date of Commencement", "expected_completion_date": "due date",
         "actual_completion_date": "Completion Date"}


def q_normalize_headers(spark, sf):
    raw = B.view(spark, sf, "projects")
    # all text, other names, and a second id column that must lose against the first
    messy = raw.select(*[c(n).cast("string").alias(MESSY[n]) for n in raw.columns], F.lit("x").alias("id"))
    return projects_out(normalize(messy, PROJECTS)[0])


# The project table as a careless office would deliver it, as CSV text: day before month, money with
# marks for missing values, ids with white space of all kinds around them, and rows without any id.
MESSY_CSV = """
select case when o % 19 = 0 then concat(chr(9), ' ') when o % 23 = 0 then null
            when o % 7 = 0 then concat(chr(9), project_id, ' ') else project_id end as `Proj ID`,
       concat(project_name, case when o % 5 = 0 then ', "phase 2"' else '' end) as `Work Name`,
       state as STATE_UT, case when o % 13 = 0 then 'N/A' else contractor end as ` vendor `,
       case when o % 17 = 0 then 'not known' when o % 3 = 0 then 'NULL' else cast(sanctioned_amount as string) end
         as `sanctionned_amount`,
       cast(latitude as string) as Lat,
       date_format(sanction_date, 'dd/MM/yyyy') as approval_date,
       date_format(start_date, 'yyyy-MM-dd') as `Date of Commencement`
from (select *, cast(substr(project_id, 2) as bigint) as o from {projects}) t"""


def _messy_folder(spark, sf):
    """Writes the table above below the scratch folder, as several CSV files."""
    folder = _fresh(spark, "messy")
    spark.sql(MESSY_CSV, projects=B.view(spark, sf, "projects")).write.option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
        f"{folder}/projects.csv")
    B.view(spark, sf, "inspections").write.parquet(f"{folder}/inspections.parquet")
    return folder


def q_messy_projects_csv(spark, sf):
    return projects_out(load_projects(spark, _messy_folder(spark, sf))[0])


def q_rejected_rows(spark, sf):
    rows = rejected_rows(find_table(spark, _messy_folder(spark, sf), "projects"), PROJECTS)
    return rows.groupBy(F.coalesce(c("STATE_UT"), F.lit("")).alias("state")).agg(
        F.count("*").alias("rows"), F.count("Proj ID").alias("blank_ids"))


def q_data_inventory(spark, sf):
    return data_inventory(load_dataset(spark, _messy_folder(spark, sf)))


def projects_out(df):
    days = [F.date_format(n, "yyyy-MM-dd").alias(n) for n in PROJECTS.dates]
    return df.select("project_id", *PROJECTS.text, *PROJECTS.numeric, *days)


def q_tfidf_terms(spark, sf):
    members = duplicates.text_members(B.projects(spark, sf), "project_id", duplicates.project_text())
    groups = duplicates.text_groups(members.where(F.size("words") > 0))
    counted = duplicates.count_terms(groups)
    terms = duplicates.tfidf_terms(counted, duplicates.shared_terms(counted), members.agg(F.count("*")).scalar())
    return rounded(terms.select(c("group").alias("project_id"), "term", "tf", "df", "weight"), 6, "weight")


def q_dup_pairs(spark, sf):
    docs, body = _documents(spark, sf)
    return duplicates.duplicate_pairs(docs, "doc_id", body)


def q_dup_text_groups(spark, sf):
    docs, body = _documents(spark, sf)
    return duplicates.similar_texts(docs, "doc_id", body)


def q_dup_document_risk(spark, sf):
    docs, body = _documents(spark, sf)
    return duplicates.duplicate_risk(docs, "doc_id", body)


def q_portfolio_insights(spark, sf):
    """The whole bundle as one table: part, name of the row, measure and its value."""
    data = B.dataset(spark, sf)
    table = assess(data, B.as_of(), include_ml=False).stored(*insights.READ_COLUMNS).risk
    parts = []
    for part, df in insights.portfolio_insights(table, data.projects).items():
        key = {"status_breakdown": "status", "signal_frequency": "signal"}.get(part, "name")
        if part == "geo_overlap_pairs":
            df = df.withColumn("name", F.concat_ws(" ", "project_id_1", "project_id_2"))
        key = c(key) if key in df.columns else F.lit("")
        for measure in MEASURES[part]:
            parts.append(df.select(F.lit(part).alias("part"), key.alias("name"), F.lit(measure).alias("measure"),
                                   c(measure).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GROUP_MEASURES = ["project_count", "average_risk_score", "flagged_count", "sanctioned_amount_at_risk"]
MEASURES = {
    "totals": ["total_projects", "flagged_projects", "flagged_percentage", "total_sanctioned_amount",
               "sanctioned_amount_at_risk", "sanctioned_at_risk_percentage"],
    "fund_tracking": ["total_sanctioned", "total_released", "total_utilized", "unutilized_funds",
                      "utilization_rate_percentage", "release_rate_percentage"],
    "status_breakdown": ["count", "percentage"], "signal_frequency": ["flagged_projects", "percentage"],
    **{f"risk_by_{kind}": GROUP_MEASURES for kind in insights.GROUP_KEYS}, "geo_overlap_pairs": ["distance_km"],
}


def q_median_impute(spark, sf):
    features = _stored_features(spark, sf)
    stats = outliers.feature_stats(features)
    return rounded(outliers.impute(features, stats), 6, *stats.features)


def q_zscore(spark, sf):
    features = _stored_features(spark, sf)
    stats = outliers.feature_stats(features)
    best = outliers.top_feature(outliers.impute(features, stats), stats)
    return best.select("project_id", "ml_top_feature", "ml_top_feature_z")


def q_isolation_forest(spark, sf):
    return outliers.ml_outliers(_stored_features(spark, sf))[0]


def q_module_top_k(spark, sf):
    # ten reports read the same table
    signals = ("financial", "delay", "progress", "contractor", "document", "image", "inspection", "duplicate", "geo", "citizen")
    read = [x[s] for x in (K.SCORE_COLUMN, K.FLAG_COLUMN) for s in signals]
    table = assess(B.dataset(spark, sf), B.as_of(), include_ml=False).stored("project_id", *read).risk
    parts = []
    for signal in signals:
        best = A.top_k(table, K.SCORE_COLUMN[signal], ["project_id", c(K.SCORE_COLUMN[signal]).alias("score")],
                       20, K.FLAG_COLUMN[signal])
        parts.append(best.withColumn("module", F.lit(signal)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_contractor_report(spark, sf):
    history = contractors.contractor_history(_features(spark, sf))
    return A.top_k(history, "contractor_risk_score",
                   ["contractor", "total_projects", "delayed_projects", "contractor_risk_score", "risk_level"],
                   20, tie="contractor")


def _readiness(spark, sf):
    data = B.dataset(spark, sf)
    return data_readiness(data, outliers.feature_stats(add_features(data.projects, B.as_of())).usable)


def q_data_readiness(spark, sf):
    ready = _readiness(spark, sf)
    return rounded(ready.withColumn("requires", F.array_join("requires", ", ")), 6, "effective_weight")


def q_portfolio_totals(spark, sf):
    return insights.portfolio_totals(_alerts(spark, sf))


def _submissions(spark, sf, streaming=False):
    if not streaming:
        return B.view(spark, sf, "submissions")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return spark.sql(B.VIEWS["submissions"].replace("from events", "from {events}"), events=events)


def reports_out(df):
    return df.withColumn("submitted_at", F.date_format("submitted_at", STAMP))


def q_citizen_checked(spark, sf):
    return reports.check_reports(_submissions(spark, sf), B.view(spark, sf, "projects"))


def _fresh(spark, label):
    return f"{scratch_dir(spark)}/worksight/{label}-{uuid.uuid4().hex}"


def q_stream_ingest(spark, sf):
    base = _fresh(spark, "intake")
    checked = intake.report_stream(_submissions(spark, sf, True), B.view(spark, sf, "projects"))
    intake.run_now(intake.write_append(checked, f"{base}/rows", f"{base}/checkpoint", available_now=True))
    return reports_out(spark.read.schema(checked.schema).parquet(f"{base}/rows"))


def q_stream_counts(spark, sf):
    base = _fresh(spark, "counts")
    checked = intake.report_stream(_submissions(spark, sf, True), B.view(spark, sf, "projects"))
    counts = intake.count_stream(reports.accepted(checked))
    intake.run_now(intake.write_counts(counts, f"{base}/rows", f"{base}/checkpoint", available_now=True))
    return intake.current_counts(spark, f"{base}/rows")


def q_decision_stream(spark, sf):
    """Decisions as a stream, checked and appended."""
    base = _fresh(spark, "decisions")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = spark.sql(B.VIEWS["verifications"].replace("from events", "from {events}"), events=events).select(
        "verification_id", "project_id", F.concat(F.lit(" "), F.lower("decision")).alias("decision"), "remarks", "verification_date")
    checked = intake.decision_stream(rows, B.view(spark, sf, "projects"))
    intake.run_now(intake.write_append(checked, f"{base}/rows", f"{base}/checkpoint", available_now=True))
    return spark.read.schema(checked.schema).parquet(f"{base}/rows").withColumn(
        "verification_date", F.date_format("verification_date", STAMP))


# Projects join the list in the course of 40 days, some before and some after the reports that name them.
JOINED_AFTER = "cast(substr(project_id, 2) as bigint) * 7919 % 40"


def q_waiting_reports(spark, sf):
    """Reports that wait up to a week for projects that are a stream as well; then both clocks pass the last wait."""
    base = _fresh(spark, "waiting")
    start = F.lit("2024-01-01").cast("timestamp")
    _submissions(spark, sf).write.parquet(f"{base}/reports")
    B.view(spark, sf, "projects").select("project_id", (start + F.expr(f"make_dt_interval(cast({JOINED_AFTER} as int))")).alias(
        "registered_at")).write.parquet(f"{base}/projects")
    kinds = {x: spark.read.parquet(f"{base}/{x}").schema for x in ("reports", "projects")}
    for _ in range(2):
        checked = waiting_reports(*[spark.readStream.schema(kinds[x]).parquet(f"{base}/{x}") for x in ("reports", "projects")])
        intake.run_now(intake.write_append(checked, f"{base}/rows", f"{base}/checkpoint", available_now=True))
        for x, time in (("reports", "submitted_at"), ("projects", "registered_at")):
            blank = spark.range(1).select(*[(start + F.expr("interval 400 days")).cast(f.dataType).alias(f.name) if f.name == time
                                            else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds[x].fields])
            blank.write.mode("append").parquet(f"{base}/{x}")
    return reports_out(spark.read.schema(checked.schema).parquet(f"{base}/rows").where("report_id is not null"))


def q_replays(spark, sf):
    """Every submission arrives twice; each is taken once."""
    base = _fresh(spark, "replays")
    twice = _submissions(spark, sf, True).unionByName(_submissions(spark, sf, True))
    checked = intake.report_stream(intake.deduplicated(twice), B.view(spark, sf, "projects"))
    intake.run_now(intake.write_append(checked, f"{base}/rows", f"{base}/checkpoint", available_now=True))
    return reports_out(spark.read.schema(checked.schema).parquet(f"{base}/rows"))


def q_alert_refresh(spark, sf):
    """Alerts maintained by the stream of accepted reports, as they stand after its last batch."""
    base = _fresh(spark, "refresh")
    data = replace(B.dataset(spark, sf), citizen_reports=None)
    assessed = assess(data, B.as_of(), include_ml=False).stored()
    checked = intake.report_stream(_submissions(spark, sf, True), data.projects)
    table = refresh.alert_table(assessed, f"{base}/alerts")
    intake.run_now(refresh.maintain_alerts(intake.count_stream(reports.accepted(checked)), assessed, table, f"{base}/checkpoint",
                                           available_now=True))
    return table.current(spark)


def q_report_status(spark, sf):
    projects = B.view(spark, sf, "projects")
    checked = reports.check_reports(_submissions(spark, sf), projects)
    return reports.report_status(_submissions(spark, sf), projects, reports.accepted(checked))


def _colocated(spark, sf):
    # A limit below the largest projects' rows, so both parts of each table take part.
    return ColocatedStore.write(B.dataset(spark, sf), _fresh(spark, "colocated"), limit=6)


def _risk_store(spark, sf):
    return RiskStore.write(_alerts(spark, sf), _fresh(spark, "serving"))


def q_surrogate_ids(spark, sf):
    rows, _ = normalize(B.view(spark, sf, "evidence_images").drop("image_id").repartition(7), IMAGES)
    return rows.select("image_id", "project_id", "image_hash", "similarity_score", "status")


def q_zero_sanction(spark, sf):
    """Money released without a sanction."""
    none = F.col("project_id").substr(F.lit(2), F.lit(20)).cast("bigint") % 9 == 0
    projects = B.projects(spark, sf).withColumn("sanctioned_amount", F.when(none, F.lit(0.0)).otherwise(c("sanctioned_amount")))
    return rules.financial_rules(add_features(projects, B.as_of()))


def q_decisions(spark, sf):
    rows = B.view(spark, sf, "verifications").select(
        "verification_id", "project_id", F.concat(F.lit(" "), F.lower("decision")).alias("decision"), "remarks",
        "verification_date")
    return reports.check_decisions(rows, B.view(spark, sf, "projects")).withColumn(
        "verification_date", F.date_format("verification_date", STAMP))


def q_history(spark, sf):
    rows = reports.decisions_of(B.view(spark, sf, "verifications"), LOOKUP)
    return rows.withColumn("verification_date", F.date_format("verification_date", STAMP))


def q_records(spark, sf):
    rows = B.projects(spark, sf).select("project_id", "status", "sanction_date", "actual_completion_date")
    return to_records(rows)


def q_risk_by_all(spark, sf):
    return insights.risk_by_all(_alerts(spark, sf))


def q_map(spark, sf):
    data = B.dataset(spark, sf)
    return A.map_projects(data.projects, assess(data, B.as_of(), include_ml=False).risk)


def _rollup(spark, sf, kind):
    if kind == "documents":
        data = B.dataset(spark, sf)
        return evidence.document_rollup(data.projects, data.documents)
    rows = _evidence(spark, sf, kind)
    return evidence.image_rollup(rows) if kind == "images" else evidence.inspection_rollup(rows)


def cols(*names):
    return lambda df: df.select(*names)


def _mk(build, *steps):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        for step in steps:
            df = step(df)
        return plain(df)
    return run


def _rule_columns(signal):
    return ["project_id", f"{signal}_anomaly", f"{signal}_risk_score"]


ALERT_OUT = ["project_id", "overall_risk_score", "risk_level", "risk_reason_count", "priority", "recommended_action",
             "alert_type", "alert_type_by_flag", "sharp_signal_fired", "alert_required", "alert_severity"]
CLOSEST = ["project_id_1", "project_name_1", "project_id_2", "project_name_2", "distance_km"]

QUERIES = {
    # sources and schema
    "normalize_headers": q_normalize_headers,
    "projects_table": _mk(B.projects, projects_out),
    "messy_projects_csv": q_messy_projects_csv,
    "rejected_rows": _mk(q_rejected_rows),
    "data_inventory": _mk(q_data_inventory),
    "records_sink": _mk(q_records),
    "readiness_totals": _mk(lambda s, f: readiness_totals(_readiness(s, f))),
    "data_readiness": _mk(q_data_readiness),
    # features and rules
    "features": _mk(_features, cols(*FEATURE_COLUMNS), lambda d: rounded(
        d, 6, "utilization_percentage", "financial_progress_percentage", "progress_mismatch", "progress_mismatch_abs")),
    "financial_rules": _mk(_features, rules.financial_rules, cols(*_rule_columns("financial"))),
    "financial_rules_without_sanction": _mk(q_zero_sanction, cols(*_rule_columns("financial"))),
    "delay_rules": _mk(_features, rules.delay_rules, cols(*_rule_columns("delay"))),
    "progress_rules": _mk(_features, rules.progress_rules, cols(*_rule_columns("progress"))),
    # contractors
    "contractor_history": _mk(_features, contractors.contractor_history, lambda d: rounded(
        d, 4, "average_completion", "average_delay_days", "total_utilized_amount")),
    "contractor_to_project": _mk(_features, contractors.contractor_scores),
    "contractor_report": _mk(q_contractor_report),
    # evidence
    "document_verification": _mk(lambda s, f: evidence.verify_documents(
        B.projects(s, f), _evidence(s, f, "documents")), cols(*DOC_ROW)),
    "image_verification": _mk(lambda s, f: evidence.verify_images(
        B.projects(s, f), _evidence(s, f, "images")), cols(*IMG_ROW)),
    "image_hash_reuse": _mk(lambda s, f: evidence.image_hash_reuse(_evidence(s, f, "images"))),
    "inspection_analysis": _mk(lambda s, f: evidence.analyze_inspections(
        B.projects(s, f), _evidence(s, f, "inspections")), cols(*INS_ROW)),
    "document_rollup": _mk(lambda s, f: _rollup(s, f, "documents")),
    "image_rollup": _mk(lambda s, f: _rollup(s, f, "images")),
    "inspection_rollup": _mk(lambda s, f: _rollup(s, f, "inspections")),
    "documents_not_supplied": _mk(lambda s, f: evidence.verify_documents(B.projects(s, f), None),
                                  cols("project_id", "document_anomaly", "document_risk_score",
                                       "document_signal_available")),
    "images_not_supplied": _mk(lambda s, f: evidence.verify_images(B.projects(s, f), None),
                               cols("project_id", "image_anomaly", "image_risk_score", "image_signal_available")),
    "inspections_not_supplied": _mk(lambda s, f: evidence.analyze_inspections(B.projects(s, f), None),
                                    cols("project_id", "inspection_anomaly", "inspection_risk_score", "inspection_score",
                                         "inspection_signal_available")),
    "surrogate_ids": _mk(q_surrogate_ids),
    # proximity
    "geo_pairs": _mk(lambda s, f: proximity.geo_pairs(B.projects(s, f))),
    "geo_project_risk": _mk(lambda s, f: proximity.geo_risk(B.dataset(s, f).projects)),
    "geo_closest20": _mk(lambda s, f: proximity.closest_pairs(B.projects(s, f)), cols(*CLOSEST)),
    # near duplicates
    "dup_pairs": _mk(q_dup_pairs),
    "dup_text_groups": _mk(q_dup_text_groups),
    "dup_project_pairs": _mk(lambda s, f: duplicates.duplicate_pairs(
        materialize(B.projects(s, f), "projects"), name="project_name")),
    "dup_closest20": _mk(lambda s, f: duplicates.most_similar_pairs(materialize(B.projects(s, f), "projects"))),
    "dup_document_risk": _mk(q_dup_document_risk),
    "dup_project_risk": _mk(lambda s, f: duplicates.duplicate_risk(B.projects(s, f))),
    "dup_below_min_rows": _mk(lambda s, f: duplicates.duplicate_risk(B.projects(s, f), min_rows=10 ** 12)),
    "tfidf_terms": _mk(q_tfidf_terms),
    # outliers
    "feature_gate": _mk(_features, outliers.feature_gate),
    "median_impute": _mk(q_median_impute),
    "zscore_top_feature": _mk(q_zscore),
    "isolation_forest": _mk(q_isolation_forest),
    "ml_report": _mk(q_isolation_forest, lambda d: A.top_k(d, "ml_anomaly_score", ["project_id", *ML_REPORT], 20, "ml_anomaly")),
    # reports and decisions
    "citizen_counts": _mk(lambda s, f: reports.citizen_risk(B.view(s, f, "citizen_reports"))),
    "citizen_ingest_valid": _mk(q_citizen_checked, reports.accepted, reports_out),
    "citizen_ingest_rejects": _mk(q_citizen_checked, reports.rejected, reports_out),
    "citizen_reports_of_project": _mk(lambda s, f: reports.reports_of(
        B.view(s, f, "citizen_reports"), LOOKUP), reports_out),
    "citizen_stream_ingest": _mk(q_stream_ingest),
    "citizen_stream_counts": _mk(q_stream_counts),
    "citizen_replays": _mk(q_replays),
    "citizen_waiting_reports": _mk(q_waiting_reports),
    "citizen_report_status": _mk(q_report_status),
    "verification_ingest": _mk(q_decisions),
    "verification_stream": _mk(q_decision_stream),
    "verification_history": _mk(q_history),
    # fusion, reasons, alerts
    "risk_fusion": _mk(lambda s, f: risk_fusion(B.dataset(s, f), B.as_of(), include_ml=False).risk,
                       cols(*FUSED_COLUMNS)),
    "risk_fusion_colocated": _mk(lambda s, f: _colocated(s, f).risk_fusion(B.as_of(), include_ml=False).risk,
                                 cols(*FUSED_COLUMNS)),
    "fusion_partial_no_documents": _mk(lambda s, f: risk_fusion(
        B.dataset(s, f, without=("documents",)), B.as_of(), include_ml=False).risk, cols(*FUSED_COLUMNS)),
    "risk_fusion_with_ml": _mk(lambda s, f: assess(B.dataset(s, f), B.as_of()).risk, joined_reasons,
                               cols(*FUSED_COLUMNS, "risk_reasons")),
    "explanations": _mk(_alerts, joined_reasons, cols("project_id", "risk_reasons", "risk_reason_count")),
    "explanations_summary": _mk(lambda s, f: _alerts(s, f, "summary"), joined_reasons,
                                cols("project_id", "risk_reasons", "risk_reason_count", "alert_type")),
    "alerts": _mk(_alerts, cols(*ALERT_OUT)),
    "investigation_rank": _mk(_alerts, lambda df: A.investigation_rank(df, ()), cols(
        "project_id", "overall_risk_score", "risk_signal_count", "investigation_rank")),
    # reports on the risk table
    "risk_summary": _mk(_alerts, A.risk_summary),
    "high_risk": _mk(_alerts, A.high_risk),
    "alert_feed": _mk(_alerts, A.alert_feed, joined_reasons),
    "alert_refresh": _mk(q_alert_refresh, cols(*ALERT_OUT, "citizen_report_count")),
    "map_join": _mk(q_map),
    "project_lookup": _mk(_alerts, lambda d: A.project_detail(d, LOOKUP), joined_reasons),
    "project_lookup_indexed": _mk(lambda s, f: _risk_store(s, f).detail(LOOKUP), joined_reasons),
    "explorer_search_indexed": _mk(lambda s, f: _risk_store(s, f).search(SEARCH, LEVEL), cols(
        "project_id", "project_name", "district", "overall_risk_score", "risk_level")),
    "explorer_search": _mk(_alerts, lambda d: A.search_projects(d, SEARCH, LEVEL), cols(
        "project_id", "project_name", "district", "overall_risk_score", "risk_level")),
    "module_top_k": _mk(q_module_top_k),
    "module_flag_counts": _mk(_alerts, lambda d: A.flag_counts(d, [
        *evidence.DOCUMENT_FLAGS, *evidence.IMAGE_FLAGS, *evidence.INSPECTION_FLAGS, *FLAGS])),
    # insights
    "portfolio_totals": _mk(q_portfolio_totals),
    "portfolio_insights": _mk(q_portfolio_insights),
    "fund_tracking": _mk(B.projects, insights.fund_tracking),
    "signal_frequency": _mk(_alerts, insights.signal_frequency),
    "status_breakdown": _mk(B.projects, insights.status_breakdown),
    "risk_by_state": _mk(_alerts, lambda d: insights.risk_by(d, "state")),
    "risk_by_district": _mk(_alerts, lambda d: insights.risk_by(d, "district")),
    "risk_by_type": _mk(_alerts, lambda d: insights.risk_by(d, "project_type")),
    "risk_by_contractor": _mk(_alerts, lambda d: insights.risk_by(d, "contractor")),
    "risk_by_all": _mk(q_risk_by_all),
}


# --- oracle --------------------------------------------------------------------

def _sel(columns, source, tail=""):
    return compose(f"select {', '.join(columns)} from {source} {tail}")


def _r(name, digits):
    return f"{even(name, digits)} as {name}"


RANKED = "order by overall_risk_score desc, risk_signal_count desc, project_id"
PROJECT_SQL = ["project_id", *PROJECTS.text, *PROJECTS.numeric,
               *[f"strftime({d}, '%Y-%m-%d') as {d}" for d in PROJECTS.dates]]
STAMPED = f"strftime(submitted_at, {SQL_STAMP}) as submitted_at"
CHECKED = ["report_id", STAMPED, "project_id", "category", "description"]
MEAN = even("cast(sum(cast(round_even(overall_risk_score * 100, 0) as bigint)) as double) / count(*) / 100", 2)
GROUPED = (f"count(*) as project_count, {MEAN} as average_risk_score, "
           f"count(*) filter (alert_required) as flagged_count, " +
           even("coalesce(sum(case when alert_required then coalesce(sanctioned_amount, 0) end), 0)", 2) +
           " as sanctioned_amount_at_risk")
MEDIAN_SQL = {x: f"coalesce(cast({x} as double), (select median(cast({x} as double)) from features))"
              for x in K.OUTLIER_FEATURES}


def _risk_by(column):
    return compose(f"select trim(coalesce({column}, 'Unknown')) as name, {GROUPED} from alert_table "
                   f"where trim(coalesce({column}, 'Unknown')) <> '' group by 1 having count(*) >= 2 "
                   f"order by average_risk_score desc, name limit 10")


def _risk_by_all():
    parts = [f"(select {text(kind)} as kind, trim(coalesce({col}, 'Unknown')) as name, {GROUPED} from alert_table "
             f"where trim(coalesce({col}, 'Unknown')) <> '' group by 2 having count(*) >= 2)"
             for kind, col in insights.GROUP_KEYS.items()]
    return compose("select * from (select *, row_number() over (partition by kind order by average_risk_score desc, "
                   f"name) as position from ({' union all '.join(parts)}) t) u where position <= 10")


def _signal_frequency():
    parts = [f"select {text(label)} as signal, count(*) filter ({flag}) as flagged_projects, "
             f"{pct(f'count(*) filter ({flag})', 'count(*)')} as percentage from alert_table"
             for flag, label in K.SIGNAL_LABELS.items()]
    return compose(" union all ".join(parts))


def _module_top_k():
    parts = []
    for s in ("financial", "delay", "progress", "contractor", "document", "image", "inspection", "duplicate", "geo",
              "citizen"):
        score = K.SCORE_COLUMN[s]
        parts.append(f"(select project_id, {score} as score, {text(s)} as module from alert_table "
                     f"where {K.FLAG_COLUMN[s]} order by {score} desc, project_id limit 20)")
    return compose(" union all ".join(parts))


def _zscore():
    z = []
    for i, x in enumerate(K.OUTLIER_FEATURES):
        z.append(f"struct_pack(z := abs({x} - (select median({x}) from imputed)) / "
                 f"(select case when stddev_samp({x}) > 0 then stddev_samp({x}) else 1e0 end from imputed), "
                 f"first := {-i}, name := {text(x)})")
    inner = ", ".join(f"{sql} as {x}" for x, sql in MEDIAN_SQL.items())
    body = compose(f"select project_id, {inner} from features")
    return (f"with imputed as materialized ({body}), best as (select project_id, list_max([{', '.join(z)}]) as b "
            f"from imputed) select project_id, b.name as ml_top_feature, {even('b.z', 2)} as ml_top_feature_z from best")


def _readiness_sql():
    weights = weights_without()
    enough = " + ".join(f"cast(count({x}) >= 20 as int)" for x in K.OUTLIER_FEATURES)
    rows = ", ".join(f"({text(s)}, {text(', '.join(K.SIGNAL_INPUTS[s]))}, {w!r}e0)" for s, w in weights.items())
    return compose(
        f"select signal, requires, true as available, case when signal = 'ml_anomaly' then "
        f"(select count(*) >= 20 and {enough} >= 2 from features) else true end as active, "
        f"{even('weight', 6)} as effective_weight from (values {rows}) t(signal, requires, weight)")


def _records():
    day = "coalesce(strftime({0}, '\"%Y-%m-%dT00:00:00.000\"'), 'null')"
    return compose("select '{\"project_id\":\"' || project_id || '\",\"status\":\"' || status || '\",\"sanction_date\":' || "
                   + day.format("sanction_date") + " || ',\"actual_completion_date\":' || "
                   + day.format("actual_completion_date") + " || '}' as record from projects")


def _pairs_by_group():
    return compose(f"""
select least(sx.first_id, sy.first_id) as group_1, greatest(sx.first_id, sy.first_id) as group_2,
       case when sx.first_id < sy.first_id then sx.copies else sy.copies end as copies_1,
       case when sx.first_id < sy.first_id then sy.copies else sx.copies end as copies_2,
       {even('s', 3)} as similarity_score
from doc_sim join text_group x on x.id = id_1 join text_group y on y.id = id_2
join text_size sx on sx.g = x.g join text_size sy on sy.g = y.g
where x.g <> y.g and sx.first_id = x.id and sy.first_id = y.id
union all select first_id, first_id, copies, copies, 1e0 from text_size where copies > 1""")


def _messy_sql(tail):
    return compose(f"""
select * from (
select case when o % 19 = 0 or o % 23 = 0 then null else project_id end as project_id, o % 19 = 0 as blank,
       project_name || case when o % 5 = 0 then ', "phase 2"' else '' end as project_name, state,
       '' as district, '' as mp_name, '' as project_type,
       case when o % 13 = 0 then 'Unknown' else contractor end as contractor, '' as agency, '' as status,
       case when o % 17 <> 0 and o % 3 <> 0 then sanctioned_amount end as sanctioned_amount,
       {", ".join(f"cast(null as double) as {x}" for x in PROJECTS.numeric if x not in ("sanctioned_amount", "latitude"))},
       latitude, strftime(sanction_date, '%Y-%m-%d') as sanction_date, strftime(start_date, '%Y-%m-%d') as start_date,
       cast(null as varchar) as expected_completion_date, cast(null as varchar) as actual_completion_date
from (select *, cast(substr(project_id, 2) as bigint) as o from projects) t) u {tail}""")


def _inventory_sql():
    there = {"project_name", "state", "contractor", "sanctioned_amount", "latitude", "sanction_date", "start_date",
             "project_id"}
    rows = [("file", x, x == "inspections") for x in ("documents", "images", "inspections")]
    # the project table itself counts as a file
    rows += [("file", "projects", True)]
    rows += [("column", x, x in there) for x in ["project_id", *PROJECTS.text, *PROJECTS.numeric, *PROJECTS.dates]]
    return "select * from (values " + ", ".join(f"({text(k)}, {text(n)}, {str(v).lower()})" for k, n, v in rows) \
        + ") t(kind, name, supplied)"


def _project_pairs(tail=""):
    """Every pair of projects with similar texts, by their texts."""
    return compose(f"""
select least(a.project_id, b.project_id) as project_id_1, greatest(a.project_id, b.project_id) as project_id_2,
       similarity_score
from (select id_1, id_2, {even('s', 3)} as similarity_score from name_sim
      union all select id, id, 1e0 from name_texts where copies > 1) t
join (select project_id, array_to_string(words, ' ') as id from name_words) a on a.id = id_1
join (select project_id, array_to_string(words, ' ') as id from name_words) b on b.id = id_2
where id_1 <> id_2 or a.project_id < b.project_id {tail}""")


def _named_pairs():
    return compose(f"select t.*, p.project_name as project_name_1, q.project_name as project_name_2 from "
                   f"({_project_pairs()}) t join projects p on p.project_id = project_id_1 "
                   f"join projects q on q.project_id = project_id_2")


def _stacked(part, name, sql):
    inner = f"select * from ({sql}) s"
    return [f"select {text(part)} as part, {name} as name, {text(m)} as measure, cast({m} as double) as value "
            f"from ({inner}) v" for m in MEASURES[part]]


def _insights_sql():
    parts = []
    for part, name, key in [("totals", "''", "portfolio_totals"), ("fund_tracking", "''", "fund_tracking"),
                            ("status_breakdown", "status", "status_breakdown"),
                            ("signal_frequency", "signal", "signal_frequency"),
                            ("risk_by_state", "name", "risk_by_state"), ("risk_by_district", "name", "risk_by_district"),
                            ("risk_by_project_type", "name", "risk_by_type"),
                            ("risk_by_contractor", "name", "risk_by_contractor"),
                            ("geo_overlap_pairs", "project_id_1 || ' ' || project_id_2", "geo_closest20")]:
        parts += _stacked(part, name, BODY[ORACLE[key]])
    return compose(" union all ".join(parts))


SCORE_ROUND = [_r("average_completion", 4), _r("average_delay_days", 4), _r("total_utilized_amount", 4)]


def _rolled(kind, flags, *more):
    """The best row per project, only for projects that have evidence."""
    table = {"document": "evidence_documents", "image": "evidence_images", "inspection": "inspections"}[kind]
    return compose(f"select {', '.join(['project_id', *flags, f'{kind}_anomaly', f'{kind}_risk_score', *more])} "
                   f"from {kind}_best where project_id in (select project_id from {table})")


ORACLE = {
    "normalize_headers": _sel(PROJECT_SQL, "projects"),
    "projects_table": _sel(PROJECT_SQL, "projects"),
    "records_sink": _records(),
    "data_readiness": _readiness_sql(),
    "features": _sel(["project_id", *[_r(x, 6) for x in FEATURE_COLUMNS[1:5]], *FEATURE_COLUMNS[5:]], "features"),
    "financial_rules": _sel(_rule_columns("financial"), "rules"),
    "delay_rules": _sel(_rule_columns("delay"), "rules"),
    "progress_rules": _sel(_rule_columns("progress"), "rules"),
    "contractor_history": _sel(["contractor", "total_projects", *SCORE_ROUND, "delayed_projects",
                                "progress_mismatch_projects", "contractor_risk_score", "risk_level"], "history"),
    "contractor_to_project": _sel(["project_id", "contractor_risk_score", "contractor_anomaly"], "contractor_map"),
    "contractor_report": _sel(["contractor", "total_projects", "delayed_projects", "contractor_risk_score",
                               "risk_level"], "history", "order by contractor_risk_score desc, contractor limit 20"),
    "document_verification": _sel([*DOC_ROW[:1], "cast(document_id as varchar) as document_id", *DOC_ROW[2:]],
                                  "document_rows"),
    "image_verification": _sel([*IMG_ROW[:1], "cast(image_id as varchar) as image_id", *IMG_ROW[2:]], "image_rows"),
    "image_hash_reuse": _sel(["image_hash", "uses"], "hash_uses"),
    "inspection_analysis": _sel([*INS_ROW[:1], "cast(inspection_id as varchar) as inspection_id", *INS_ROW[2:]],
                                "inspection_rows"),
    "document_rollup": _rolled("document", evidence.DOCUMENT_FLAGS),
    "image_rollup": _rolled("image", evidence.IMAGE_FLAGS, "similarity_score"),
    "inspection_rollup": _rolled("inspection", evidence.INSPECTION_FLAGS, "inspection_score"),
    "documents_not_supplied": _sel(["project_id", "false as document_anomaly", "0e0 as document_risk_score",
                                    "false as document_signal_available"], "projects"),
    "geo_pairs": _sel(["id_1 as project_id_1", "name_1 as project_name_1", "id_2 as project_id_2",
                       "name_2 as project_name_2", f"{even('km', 3)} as distance_km"], "near"),
    "geo_project_risk": _sel(["project_id", "geo_anomaly", "geo_risk_score", "geo_overlap_count", "geo_nearest_km"],
                             "geo_best"),
    "geo_closest20": _sel(["id_1 as project_id_1", "name_1 as project_name_1", "id_2 as project_id_2",
                           "name_2 as project_name_2", f"{even('km', 3)} as distance_km"], "near",
                          "order by distance_km, project_id_1, project_id_2 limit 20"),
    "dup_pairs": _sel(["id_1 as doc_id_1", "id_2 as doc_id_2", f"{even('s', 3)} as similarity_score"], "doc_sim"),
    "dup_text_groups": _pairs_by_group(),
    "dup_project_risk": _sel(["project_id", "duplicate_anomaly", "duplicate_risk_score", "duplicate_match_score"],
                             "dup_best"),
    "tfidf_terms": _sel(["(select min(project_id) from name_words w where array_to_string(w.words, ' ') = v.id) "
                         "as project_id", "term", "tf", "df", f"{even('w', 6)} as weight"], "name_vec v"),
    "feature_gate": _sel(["count(*) as rows", *[f"count({x}) as {x}" for x in K.OUTLIER_FEATURES]], "features"),
    "median_impute": compose("select project_id, " + ", ".join(
        f"{even(sql, 6)} as {x}" for x, sql in MEDIAN_SQL.items()) + " from features"),
    "zscore_top_feature": _zscore(),
    "citizen_counts": _sel(["project_id", "citizen_report_count", "citizen_risk_score", "citizen_anomaly"],
                           "citizen_best"),
    "citizen_ingest_valid": _sel(CHECKED, "checked", "where reject_reason is null"),
    "citizen_ingest_rejects": _sel([*CHECKED, "reject_reason"], "checked", "where reject_reason is not null"),
    "citizen_reports_of_project": _sel(["report_id", "project_id", "category", "description", STAMPED],
                                       "citizen_reports", f"where project_id = '{LOOKUP}' order by report_id desc"),
    "citizen_stream_ingest": _sel([*CHECKED, "reject_reason"], "checked"),
    "citizen_stream_counts": _sel(
        ["project_id", "count(*) as citizen_report_count",
         "cast(least(count(*) * 25, 100) as double) as citizen_risk_score", "true as citizen_anomaly"],
        "checked", "where reject_reason is null group by project_id"),
    "verification_ingest": _sel(
        ["v.verification_id", "v.project_id", "v.decision", "v.remarks", "'Demo Officer' as verified_by",
         f"strftime(v.verification_date, {SQL_STAMP}) as verification_date",
         "case when p.project_id is null then 'project not found' end as reject_reason"],
        "verifications v left join projects p using (project_id)"),
    "verification_history": _sel(
        ["verification_id", "project_id", "decision", "remarks",
         f"strftime(verification_date, {SQL_STAMP}) as verification_date"],
        "verifications", f"where project_id = '{LOOKUP}' order by verification_id"),
    "risk_fusion": _sel(FUSED_COLUMNS, "risk"),
    "fusion_partial_no_documents": _sel(FUSED_COLUMNS, "risk_no_documents"),
    "explanations": _sel(["project_id", "risk_reasons", "risk_reason_count"], "alert_table"),
    "explanations_summary": _sel(["project_id", "risk_reasons", "risk_reason_count", "alert_type"], "alert_summary"),
    "alerts": _sel(ALERT_OUT, "alert_table"),
    "investigation_rank": _sel(["project_id", "overall_risk_score", "risk_signal_count",
                                f"row_number() over ({RANKED}) as investigation_rank"], "alert_table"),
    "risk_summary": _sel(
        ["count(*) as total_projects", *[f"count(*) filter (risk_level = '{x.upper()}') as {x}_risk"
                                         for x in ("low", "medium", "high", "critical")],
         "count(*) filter (alert_required) as total_alerts", f"{MEAN} as average_risk_score"], "alert_table"),
    "high_risk": _sel(A.HIGH_RISK_COLUMNS, "alert_table", f"where risk_level in ('HIGH', 'CRITICAL') {RANKED}"),
    "alert_feed": _sel(A.ALERT_COLUMNS, "alert_table", f"where alert_required {RANKED}"),
    "map_join": _sel(["project_id", "project_name", "state", "district", "latitude", "longitude", *A.MAP_COLUMNS],
                     "alert_table", "where latitude is not null and longitude is not null"),
    "project_lookup": _sel(A.DETAIL_COLUMNS, "alert_table", f"where project_id = '{LOOKUP}'"),
    "explorer_search": _sel(
        ["project_id", "project_name", "district", "overall_risk_score", "risk_level"], "alert_table",
        f"where risk_level = '{LEVEL}' and (" + " or ".join(
            f"contains(lower({x}), '{SEARCH}')" for x in A.SEARCHED) + f") {RANKED} limit 200"),
    "module_top_k": _module_top_k(),
    "module_flag_counts": _sel(["count(*) as rows", *[f"count(*) filter ({x}) as {x}" for x in [
        *evidence.DOCUMENT_FLAGS, *evidence.IMAGE_FLAGS, *evidence.INSPECTION_FLAGS, *FLAGS]]], "alert_table"),
    "portfolio_totals": compose(f"""
select count(*) as total_projects, count(*) filter (alert_required) as flagged_projects,
       {pct("count(*) filter (alert_required)", "count(*)")} as flagged_percentage,
       {even("coalesce(sum(sanctioned_amount), 0)", 2)} as total_sanctioned_amount,
       {even("coalesce(sum(sanctioned_amount) filter (alert_required), 0)", 2)} as sanctioned_amount_at_risk,
       {pct("coalesce(sum(sanctioned_amount) filter (alert_required), 0)", "sum(sanctioned_amount)")}
         as sanctioned_at_risk_percentage
from alert_table"""),
    "fund_tracking": compose(f"""
select {even("sum(sanctioned_amount)", 2)} as total_sanctioned, {even("sum(released_amount)", 2)} as total_released,
       {even("sum(utilized_amount)", 2)} as total_utilized,
       {even("sum(released_amount) - sum(utilized_amount)", 2)} as unutilized_funds,
       {pct("sum(utilized_amount)", "sum(released_amount)")} as utilization_rate_percentage,
       {pct("sum(released_amount)", "sum(sanctioned_amount)")} as release_rate_percentage
from projects"""),
    "signal_frequency": _signal_frequency(),
    "status_breakdown": compose(
        f"select case when trim(coalesce(status, '')) <> '' then trim(status) else 'Unknown' end as status, "
        f"count(*) as count, {pct('count(*)', '(select count(*) from projects)')} as percentage "
        f"from projects group by 1"),
    "risk_by_state": _risk_by("state"),
    "risk_by_district": _risk_by("district"),
    "risk_by_type": _risk_by("project_type"),
    "risk_by_contractor": _risk_by("contractor"),
    "risk_by_all": _risk_by_all(),
}
MESSY_OUT = ["project_id", *PROJECTS.text, *PROJECTS.numeric, *PROJECTS.dates]
ORACLE |= {
    "alert_refresh": _sel([*ALERT_OUT, "citizen_report_count"], "alert_stream"),
    "risk_fusion_colocated": ORACLE["risk_fusion"],
    "project_lookup_indexed": ORACLE["project_lookup"],
    "explorer_search_indexed": ORACLE["explorer_search"],
    "images_not_supplied": _sel(["project_id", "false as image_anomaly", "0e0 as image_risk_score",
                                 "false as image_signal_available"], "projects"),
    "inspections_not_supplied": _sel(["project_id", "false as inspection_anomaly", "0e0 as inspection_risk_score",
                                      "0e0 as inspection_score", "false as inspection_signal_available"], "projects"),
    "surrogate_ids": compose(f"""
select cast(row_number() over (order by {", ".join(f"{x} nulls first" for x in IMAGES.canonical if x != "image_id")}) as varchar)
         as image_id, project_id, image_hash, similarity_score, status from evidence_images"""),
    "financial_rules_without_sanction": _sel(_rule_columns("financial"), "rules_zero"),
    "dup_below_min_rows": _sel(["project_id", "false as duplicate_anomaly", "0e0 as duplicate_risk_score",
                                "0e0 as duplicate_match_score"], "projects"),
    "citizen_replays": _sel([*CHECKED, "reject_reason"], "checked"),
    "citizen_waiting_reports": compose(f"""
select report_id, {STAMPED}, s.project_id, category, description,
       case when p.project_id is null or timestamp '2024-01-01 00:00:00' + to_days(cast({JOINED_AFTER.replace("project_id", "p.project_id")} as int))
                 > submitted_at + interval 7 day then 'project not found' else reject_reason end as reject_reason
from checked s left join projects p on p.project_id = s.project_id"""),
    "citizen_report_status": compose("""
select s.project_id, any_value(p.project_id) is not null as known, count(*) filter (reject_reason is null) as citizen_report_count
from checked s left join projects p on p.project_id = s.project_id group by s.project_id"""),
    "verification_stream": ORACLE["verification_ingest"],
    "messy_projects_csv": f"select {', '.join(MESSY_OUT)} from ({_messy_sql('where project_id is not null')}) t",
    "rejected_rows": f"select state, count(*) as rows, count(*) filter (blank) as blank_ids from "
                     f"({_messy_sql('where project_id is null')}) t group by state",
    "data_inventory": _inventory_sql(),
    "readiness_totals": f"select count(*) filter (available) as signals_available, count(*) as signals_total "
                        f"from ({_readiness_sql()}) t",
    "dup_project_pairs": _named_pairs(),
    "dup_closest20": _project_pairs("order by similarity_score desc, project_id_1, project_id_2 limit 20"),
    "dup_document_risk": compose(f"""
select t.doc_id, coalesce(best, 0e0) > 0 as duplicate_anomaly,
       {even("least(coalesce(best, 0e0) * 100, 1e2)", 2)} as duplicate_risk_score,
       coalesce(best, 0e0) as duplicate_match_score
from documents t left join (
  select id, max({even('s', 3)}) as best from (
    select id_1 as id, s from doc_sim union all select id_2, s from doc_sim) u group by id) b on b.id = t.doc_id"""),
    "portfolio_insights": _insights_sql(),
    "isolation_forest": _sel(["project_id", "ml_anomaly", *ML_REPORT, "true as ml_signal_available"], "forest_best"),
    "ml_report": _sel(["project_id", *ML_REPORT], "forest_best",
                      "where ml_anomaly order by ml_anomaly_score desc, project_id limit 20"),
    "risk_fusion_with_ml": _sel([*FUSED_COLUMNS, "risk_reasons"], "alert_model"),
}
