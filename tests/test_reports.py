import datetime as dt

import pytest

from worksight.operators import reports as R
from worksight.streaming import (count_stream, current_counts, decision_stream, deduplicated, report_stream, run_now,
                                 write_append, write_counts)

SUBMISSION = "report_id long, project_id string, category string, description string, reporter_name string, " \
             "reporter_contact string, submitted_at timestamp"
AT = dt.datetime(2024, 1, 1)
ROWS = [(1, " P0 ", "poor_quality ", " bad ", None, "c", AT), (2, "P0", "OTHER", "x", " n ", "c", AT),
        (3, "P9", "OTHER", "x", "", "", AT), (4, "P1", "NONSENSE", "x", "", "", AT), (5, "P1", "OTHER", "  ", "", "", AT),
        (6, "P1", None, "x", "", "", AT), (7, None, "OTHER", "x", "", "", AT)]
REASONS = {3: "project not found", 4: "invalid category", 5: "description required", 6: "invalid category",
           7: "project not found"}


@pytest.fixture
def projects(make_projects):
    return make_projects({}, {})


def test_check_reports(spark, projects):
    checked = R.check_reports(spark.createDataFrame(ROWS, SUBMISSION), projects)
    good = {r.report_id: r for r in R.accepted(checked).collect()}
    assert set(good) == {1, 2}
    assert (good[1].project_id, good[1].category, good[1].description, good[1].reporter_name) == (
        "P0", "POOR_QUALITY", "bad", "")
    assert {r.report_id: r.reject_reason for r in R.rejected(checked).collect()} == REASONS


def test_append_and_read(spark, projects, tmp_path):
    path = str(tmp_path / "reports")
    for part in (ROWS[:1], ROWS[1:]):
        R.append(R.accepted(R.check_reports(spark.createDataFrame(part, SUBMISSION), projects)), path)
    stored = spark.read.parquet(path)
    shown = R.reports_of(stored, " P0 ").collect()
    assert [r.report_id for r in shown] == [2, 1] and "reporter_contact" not in shown[0].asDict()
    assert tuple(R.citizen_risk(stored).first()) == ("P0", 2, 50.0, True)


def test_score_is_capped(spark):
    counts = spark.createDataFrame([("a", 4), ("b", 5), ("c", 1)], "project_id string, citizen_report_count long")
    assert [r.citizen_risk_score for r in R.score_counts(counts).orderBy("project_id").collect()] == [100.0, 100.0, 25.0]


def test_decisions(spark, projects):
    rows = [(1, "P0", " verified", None), (2, "P0", "ESCALATED", "r"), (3, "P0", "MAYBE", ""), (4, "P7", "DISMISSED", "")]
    checked = R.check_decisions(
        spark.createDataFrame(rows, "verification_id long, project_id string, decision string, remarks string"), projects)
    assert {r.verification_id: r.reject_reason for r in R.rejected(checked).collect()} == {
        3: "invalid decision", 4: "project not found"}
    kept = R.accepted(checked)
    assert [r.decision for r in R.decisions_of(kept, "P0").collect()] == ["VERIFIED", "ESCALATED"]
    assert [r.verification_id for r in R.decisions_of(kept, "P0", newest_first=True).collect()] == [2, 1]
    assert kept.first().verified_by == "Demo Officer" and kept.first().verification_date is not None


def stream(spark, folder):
    return spark.readStream.schema(SUBMISSION).parquet(folder)


def test_stream_equals_batch_over_several_runs(spark, projects, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (ROWS[:1], ROWS[1:4], ROWS[4:]):
        spark.createDataFrame(part, SUBMISSION).write.mode("append").parquet(source)
        checked = report_stream(stream(spark, source), projects)
        run_now(write_append(checked, f"{out}/rows", f"{out}/cp1", available_now=True))
        run_now(write_counts(count_stream(R.accepted(checked)), f"{out}/counts", f"{out}/cp2", available_now=True))
    want = R.check_reports(spark.createDataFrame(ROWS, SUBMISSION), projects)
    got = spark.read.parquet(f"{out}/rows").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [tuple(r) for r in current_counts(spark, f"{out}/counts").collect()] == [("P0", 2, 50.0, True)]


def test_replays_are_dropped(spark, projects, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(ROWS[:2] + ROWS[:2], SUBMISSION).write.parquet(source)
    checked = R.accepted(report_stream(deduplicated(stream(spark, source)), projects))
    run_now(write_append(checked, f"{out}/rows", f"{out}/cp", available_now=True))
    assert sorted(r.report_id for r in spark.read.parquet(f"{out}/rows").collect()) == [1, 2]


def test_decision_stream(spark, projects, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "verification_id long, project_id string, decision string, remarks string"
    spark.createDataFrame([(1, "P1", "verified", ""), (2, "P1", "?", "")], schema).write.parquet(source)
    checked = decision_stream(spark.readStream.schema(schema).parquet(source), projects)
    run_now(write_append(checked, f"{out}/rows", f"{out}/cp", available_now=True))
    rows = {r.verification_id: r.reject_reason for r in spark.read.parquet(f"{out}/rows").collect()}
    assert rows == {1: None, 2: "invalid decision"}
