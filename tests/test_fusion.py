import itertools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from worksight import Dataset, assess, risk_fusion
from worksight import constants as K
from worksight.operators import alerts as A, insights as I
from worksight.operators.explain import explain
from worksight.operators.fusion import data_inventory, data_readiness, effective_weights, fuse, signal_availability
from worksight.plans.pipeline import repeated_ids
from worksight.sources import DOCUMENTS, load_dataset, normalize


def test_weights_sum_to_one_for_every_availability():
    for bits in itertools.product((False, True), repeat=11):
        weights = effective_weights(dict(zip(K.SIGNAL_WEIGHTS, bits)))
        assert sum(weights.values()) == pytest.approx(1.0 if any(bits) else 0.0)
        assert all((w > 0) == on for w, on in zip(weights.values(), bits))


def test_availability_from_columns_and_files():
    got = signal_availability({"sanctioned_amount": True, "start_date": True, "latitude": True, "project_name": True},
                              {"images": True}, False)
    assert [s for s, on in got.items() if on] == ["financial", "image", "duplicate", "citizen"]


def test_bare_project_table(make_projects):
    data = Dataset(make_projects(dict(status="Delayed"), {}))
    result = assess(data, F.lit("2022-01-01").cast("date"))
    assert not result.availability["document"] and not result.availability["ml_anomaly"]
    rows = {r.project_id: r for r in result.risk.collect()}
    assert len(rows) == 2 and rows["P0"].risk_signal_count == 1
    assert rows["P0"].risk_reasons == ["Project shows a delay/stalling signal"]
    assert rows["P1"].risk_reasons == ["No significant anomaly signals detected"]
    assert rows["P1"].priority == "P5 - NORMAL" and rows["P0"].priority == "P4 - REVIEW"
    assert rows["P0"].alert_type == "DELAY ALERT" and not rows["P0"].alert_required
    assert rows["P0"].alert_severity == "NONE" and rows["P1"].alert_type == "GENERAL REVIEW ALERT"


def test_many_files_of_one_project_stay_one_row(spark, make_projects):
    projects = make_projects(dict(contractor="A", utilized_amount=1.0), dict(contractor="B"))
    docs = normalize(spark.range(500).selectExpr("id as document_id", "'P0' as project_id", "1.0D as amount",
                                                 "case when id = 7 then 'Z' else 'A' end as contractor"), DOCUMENTS)[0]
    rows = {r.project_id: r for r in risk_fusion(Dataset(projects, docs), include_ml=False).risk.collect()}
    assert len(rows) == 2
    assert rows["P0"].contractor_mismatch and rows["P0"].document_risk_score == 30.0
    assert rows["P1"].missing_document and rows["P1"].document_anomaly


def fused_row(spark, **values):
    names = {**{n: 0.0 for n in K.SCORE_COLUMN.values()}, **{n: False for n in K.FLAG_COLUMN.values()}}
    names |= {"project_id": "P", "citizen_report_count": 0, "geo_overlap_count": 0, "delay_days": 0,
              "progress_mismatch": 0.0, "ml_top_feature": "", "similarity_score": 0.0, "inspection_score": 0.0,
              **{f: False for f in ("amount_mismatch", "contractor_mismatch", "location_mismatch", "missing_document",
                                    "reused_image", "high_similarity", "missing_image", "failed_inspection",
                                    "needs_improvement", "low_inspection_score", "missing_inspection")}}
    names |= values
    return spark.range(1).select(*[
        (F.lit(v) if v is not None else F.lit(None).cast("double")).alias(n) for n, v in names.items()])


ON = dict.fromkeys(K.SIGNAL_WEIGHTS, True)


def said(spark, detail=True, **values):
    return explain(fuse(fused_row(spark, **values), ON), detail).first().risk_reasons


def test_reasons_with_detail(spark):
    assert said(spark, financial_anomaly=True, financial_risk_score=70.0) == [
        "Significant financial anomaly detected (financial risk: 70/100)"]
    assert said(spark, delay_anomaly=True, delay_days=12) == ["Project is delayed by approximately 12 days"]
    assert said(spark, progress_anomaly=True, progress_mismatch=-33.25) == [
        "Financial and physical progress show a mismatch of approximately 33.2%"]
    assert said(spark, progress_anomaly=True, progress_mismatch=None) == [
        "Financial and physical progress mismatch detected"]
    assert said(spark, document_anomaly=True, amount_mismatch=True, missing_document=True) == [
        "Document amount does not match the project expenditure", "Required project document is missing"]
    assert said(spark, image_anomaly=True, high_similarity=True, similarity_score=0.925, missing_image=True) == [
        "Highly similar image detected (similarity: 0.92)"]
    assert said(spark, image_anomaly=True) == ["Image evidence requires verification"]
    assert said(spark, inspection_anomaly=True, low_inspection_score=True, inspection_score=42.5) == [
        "Low inspection score detected (42/100)"]
    assert said(spark, ml_anomaly=True, ml_top_feature="delay_days", ml_anomaly_score=88.5)[0].endswith(
        "driven mostly by schedule delay (anomaly score: 88/100)")
    assert "its overall profile" in said(spark, ml_anomaly=True)[0]
    assert said(spark, citizen_anomaly=True, citizen_report_count=3)[0].startswith("3 citizen report(s)")
    assert "with 2 other" in said(spark, geo_anomaly=True, geo_overlap_count=2)[0]
    assert said(spark, contractor_risk_score=40.0) == ["Contractor shows moderate historical risk pattern (40/100)"]
    assert said(spark, contractor_risk_score=39.0) == ["No significant anomaly signals detected"]


def test_reasons_without_detail(spark):
    got = said(spark, False, delay_anomaly=True, delay_days=12, progress_anomaly=True, progress_mismatch=40.0,
               document_anomaly=True, amount_mismatch=True, image_anomaly=True, reused_image=True,
               inspection_anomaly=True, failed_inspection=True)
    assert got == ["Project shows a delay/stalling signal",
                   "Financial and physical progress show a mismatch of approximately 0.0%",
                   "Image evidence requires verification"]


def alert(spark, **values):
    return A.add_alerts(explain(fuse(fused_row(spark, **values), ON))).first()


def test_alert_types_by_wording_and_by_flag(spark):
    r = alert(spark, progress_anomaly=True)
    assert r.alert_type == "FINANCIAL ALERT" and r.alert_type_by_flag == "GENERAL REVIEW ALERT"
    r = alert(spark, geo_anomaly=True, geo_overlap_count=1)
    assert r.alert_type == "DUPLICATE PROJECT ALERT" and r.alert_type_by_flag == "GEO-SPATIAL OVERLAP ALERT"
    r = alert(spark, ml_anomaly=True, ml_top_feature="completion_percentage")
    assert r.alert_type == "ML ANOMALY ALERT" and r.alert_severity == "MEDIUM"
    r = alert(spark, citizen_anomaly=True, citizen_report_count=1)
    assert r.alert_type == "CITIZEN REPORTED ALERT" and r.alert_required and r.sharp_signal_fired


@pytest.mark.parametrize("value, level, priority, severity", [
    (100.0, "CRITICAL", "P1 - IMMEDIATE", "CRITICAL"), (90.0, "CRITICAL", "P1 - IMMEDIATE", "CRITICAL"),
    (89.99, "HIGH", "P2 - HIGH PRIORITY", "HIGH"), (70.0, "HIGH", "P2 - HIGH PRIORITY", "HIGH"),
    (40.0, "MEDIUM", "P3 - MONITOR", "MEDIUM"), (39.99, "LOW", "P5 - NORMAL", "NONE")])
def test_levels(spark, value, level, priority, severity):
    r = alert(spark, **{n: value for n in K.SCORE_COLUMN.values()})
    assert (r.overall_risk_score, r.risk_level, r.priority, r.alert_severity) == (value, level, priority, severity)
    assert r.alert_required == (value >= 40)


def test_unavailable_signals_do_not_flag(spark):
    off = {**ON, "document": False, "financial": False}
    r = fuse(fused_row(spark, document_anomaly=True, financial_anomaly=True, document_risk_score=100.0), off).first()
    assert not r.document_anomaly and r.financial_anomaly and r.overall_risk_score == 0.0


def table(spark):
    return spark.createDataFrame(
        [("P1", "A", " x", 80.0, "HIGH", 5, True, 10.0, "Done", True), ("P2", "a", "x", 50.0, "MEDIUM", 2, True, None, " ", False),
         ("P3", "b", None, 10.01, "LOW", 0, False, 30.0, "Done", False), ("P4", "b", "", 10.02, "LOW", 0, False, 5.0, None, False)],
        "project_id string, project_name string, state string, overall_risk_score double, risk_level string, "
        "risk_signal_count int, alert_required boolean, sanctioned_amount double, status string, geo_anomaly boolean")


def test_insights(spark):
    t = table(spark)
    got = I.portfolio_totals(t).first()
    assert (got.total_projects, got.flagged_projects, got.flagged_percentage, got.total_sanctioned_amount,
            got.sanctioned_amount_at_risk, got.sanctioned_at_risk_percentage) == (4, 2, 50.0, 45.0, 10.0, 22.2)
    by = I.risk_by(t, "state").collect()
    assert [tuple(r) for r in by] == [("x", 2, 65.0, 2, 10.0)]                 # "Unknown" has one row only
    assert [tuple(r) for r in I.status_breakdown(t).collect()] == [("Done", 2, 50.0), ("Unknown", 2, 50.0)]
    s = A.risk_summary(t).first()
    assert (s.low_risk, s.medium_risk, s.high_risk, s.critical_risk, s.total_alerts, s.average_risk_score) == (
        2, 1, 1, 0, 2, 37.51)
    assert I.portfolio_totals(t.limit(0)).first().flagged_percentage == 0.0


def test_search_and_top(spark):
    t = table(spark).withColumns({"district": F.lit("D"), "mp_name": F.lit("M"), "contractor": F.lit("C")})
    assert [r.project_id for r in A.search_projects(t, " A ").collect()] == ["P1", "P2"]
    assert [r.project_id for r in A.search_projects(t, "p", "LOW").collect()] == ["P4", "P3"]
    assert A.search_projects(t, limit=3).count() == 3
    assert [r.project_id for r in A.top_k(t, "overall_risk_score", ["project_id"], 1, "geo_anomaly").collect()] == ["P1"]
    assert tuple(A.flag_counts(t, ["alert_required", "geo_anomaly"]).first()) == (4, 2, 1)


def test_readiness(make_projects):
    rows = {r.signal: r for r in data_readiness(Dataset(make_projects({})), False).collect()}
    assert len(rows) == 11 and rows["ml_anomaly"].available and not rows["ml_anomaly"].active
    assert not rows["document"].available and rows["document"].effective_weight == 0.0
    assert sum(r.effective_weight for r in rows.values()) == pytest.approx(1.0)


def test_inventory(make_projects):
    rows = {(r.kind, r.name): r.supplied for r in data_inventory(Dataset(make_projects({}))).collect()}
    assert rows["file", "projects"] and not rows["file", "images"] and rows["column", "latitude"]


def test_all_insights_of_one_portfolio(make_projects):
    projects = make_projects(*[dict(state="S", latitude=10.0, longitude=20.0, sanctioned_amount=10.0,
                                    released_amount=8.0, utilized_amount=2.0, status="Done") for _ in range(6)])
    got = I.portfolio_insights(assess(Dataset(projects)).stored().risk, projects)
    assert got["totals"].first().flagged_projects == 6 and got["geo_overlap_pairs"].count() == 15
    f = got["fund_tracking"].first()
    assert (f.total_released, f.unutilized_funds, f.utilization_rate_percentage, f.release_rate_percentage) == (
        48.0, 36.0, 25.0, 80.0)
    first = got["signal_frequency"].first()
    assert (first.signal, first.flagged_projects, first.percentage) == ("Geo-Spatial Overlap", 6, 100.0)
    assert [r.name for r in got["risk_by_state"].collect()] == ["S"] and got["risk_by_district"].count() == 0


def test_rows_of_a_repeated_id_are_kept_and_not_multiplied(make_projects):
    same = dict(project_id="P0", project_name="Village hall roof", contractor="A", latitude=10.0, longitude=70.0)
    projects = make_projects(same, same, {**same, "contractor": "B"}, *[
        dict(project_id=f"P{i}", project_name=f"Road {'abcdefgh'[i] * 3}", latitude=20.0 + i, longitude=70.0)
        for i in range(1, 5)])
    assert [tuple(r) for r in repeated_ids(projects).collect()] == [("P0", 3)]
    rows = risk_fusion(Dataset(projects), include_ml=False).risk.collect()
    assert sorted(r.project_id for r in rows) == ["P0", "P0", "P0", "P1", "P2", "P3", "P4"]
    assert all(r.duplicate_anomaly == (r.project_id == "P0") == r.geo_anomaly for r in rows)


def test_raw_projects_are_read_only_while_they_are_stored(spark, make_projects, tmp_path):
    make_projects(*[dict(project_name=f"Hall {i}", latitude=float(i), longitude=70.0) for i in range(30)]).write.option(
        "header", True).csv(str(tmp_path / "projects.csv"))
    risk = assess(load_dataset(spark, str(tmp_path))).risk
    assert risk.count() == 30 and not any("projects.csv" in f for f in risk.inputFiles())


def test_search_without_a_limit(spark):
    table = spark.range(300).selectExpr(
        "concat('P', id) as project_id", "'Hall' as project_name", "'' as district", "'' as mp_name",
        "'' as contractor", "1.0D as overall_risk_score", "'LOW' as risk_level", "0 as risk_signal_count")
    assert A.search_projects(table, "hall").count() == 200
    assert A.search_projects(table, "hall", limit=None).count() == 300


def test_stored_projects_are_not_written_again(make_projects, monkeypatch):
    from worksight.plans import pipeline

    written = []
    monkeypatch.setattr(pipeline, "materialize", lambda df, label: written.append(label) or df)
    data = Dataset(make_projects({}, {}))
    risk_fusion(data, include_ml=False)
    assert written == ["projects"]
    risk_fusion(replace(data, stored=True), include_ml=False)
    assert written == ["projects"]
