"""Submissions that wait for their project."""

import datetime as dt

from worksight.streaming import run_now, waiting_decisions, waiting_reports, write_append

REPORT = "report_id long, project_id string, category string, description string, submitted_at timestamp"
DECISION = "verification_id long, project_id string, decision string, remarks string, verification_date timestamp"
PROJECT = "project_id string, registered_at timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def run_batches(spark, tmp_path, check, schema, batches, key):
    """reject_reason by id after each pair of new submissions and new projects."""
    folder, seen = str(tmp_path), []
    for submitted, projects in batches:
        spark.createDataFrame(submitted, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame(projects, PROJECT).coalesce(1).write.mode("append").parquet(f"{folder}/projects")
        checked = check(spark.readStream.schema(schema).parquet(f"{folder}/in"), spark.readStream.schema(PROJECT).parquet(f"{folder}/projects"),
                        wait="2 days")
        run_now(write_append(checked, f"{folder}/rows", f"{folder}/checkpoint", available_now=True))
        rows = [(r[key], r["reject_reason"]) for r in spark.read.parquet(f"{folder}/rows").collect()]
        assert len(rows) == len(dict(rows))
        seen.append(dict(rows))
    return seen


def test_reports_wait_for_their_project(spark, tmp_path):
    first = [(1, " P1 ", "other", "known at once", at(2)), (2, "P2", "OTHER", "project comes later", at(2)),
             (3, "P9", "OTHER", "project never comes", at(2)), (4, "P1", "NONSENSE", "x", at(2)), (5, "P2", "OTHER", "  ", at(2, 1))]
    batches = [(first, [("P1", at(1)), ("P1", at(1, 5)), (None, at(2))]),
               ([(6, "P1", "OTHER", "x", at(3))], [("P2", at(3)), (None, at(3))]),
               ([(7, "P3", "OTHER", "project too late", at(3, 2))], [(" P2 ", at(3, 2))]),
               ([(8, "P1", "OTHER", "moves the clock", at(9))], [("P3", at(8)), (None, at(9))])]
    seen = run_batches(spark, tmp_path, waiting_reports, REPORT, batches, "report_id")
    assert seen[0] == {1: None, 4: "invalid category"}
    assert seen[1] == {**seen[0], 2: None, 5: "description required", 6: None}
    assert seen[2] == seen[1]
    assert seen[3] == {**seen[2], 3: "project not found", 7: "project not found", 8: None}


def test_decisions_wait_for_their_project(spark, tmp_path):
    batches = [([(1, "P1", "verified", None, at(2)), (2, "P1", "?", "", at(2)), (3, None, "VERIFIED", "", at(2))], [(None, at(2))]),
               ([(4, "P5", "VERIFIED", "", at(9))], [("P1", at(2, 3)), (None, at(9))])]
    seen = run_batches(spark, tmp_path, waiting_decisions, DECISION, batches, "verification_id")
    assert seen[0] == {}
    assert seen[1] == {1: None, 2: "invalid decision", 3: "project not found"}
