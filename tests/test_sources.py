import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from worksight.sources import (DOCUMENTS, IMAGES, PROJECTS, load_dataset, load_evidence, normalize, probe_files,
                               read_table, rejected_rows, resolve_headers, to_records, write_records)


def test_synonyms_case_and_spaces():
    at = resolve_headers(["Proj ID", "AMOUNT-SANCTIONED", "utilised_amount", "Physical Progress", "lat", "LNG",
                          " vendor ", "work_status"], PROJECTS)
    assert at == {"project_id": 0, "sanctioned_amount": 1, "utilized_amount": 2, "completion_percentage": 3,
                  "latitude": 4, "longitude": 5, "contractor": 6, "status": 7}


def test_first_of_two_candidates_wins():
    assert resolve_headers(["id", "project_id", "project_id"], PROJECTS) == {"project_id": 0}


def test_fuzzy_claims_each_header_once():
    at = resolve_headers(["project_id", "sanctionned_amount", "relased_amount"], PROJECTS)
    assert at["sanctioned_amount"] == 1 and at["released_amount"] == 2
    assert "sanctionned_amount" not in at


def test_unrelated_header_keeps_its_name():
    assert resolve_headers(["id", "zzz"], PROJECTS)["zzz"] == 1


def test_missing_id_is_an_error(spark):
    with pytest.raises(ValueError):
        normalize(spark.createDataFrame([("a",)], "project_name string"), PROJECTS)


def test_defaults_coercion_and_availability(spark):
    raw = spark.createDataFrame([(" 7 ", None, "12.5", "x"), ("8", "Z", "NaN", "inf"), ("9", "", "1.5d", "1e3"),
                                 (None, "q", "1", "2")],
                                "id string, vendor string, sanctioned_amount string, released_amount string")
    df, has = normalize(raw, PROJECTS)
    rows = {r.project_id: r for r in df.collect()}
    assert set(rows) == {"7", "8", "9"}
    assert rows["7"].contractor == "Unknown" and rows["8"].contractor == "Z" and rows["9"].contractor == ""
    assert rows["7"].sanctioned_amount == 12.5 and rows["7"].released_amount is None
    assert rows["8"].sanctioned_amount is None and rows["8"].released_amount is None
    assert rows["9"].sanctioned_amount is None and rows["9"].released_amount == 1000.0
    assert rows["7"].state == "" and rows["7"].latitude is None and rows["7"].start_date is None
    assert has["contractor"] and has["project_id"] and not has["state"] and not has["start_date"]
    assert [r.vendor for r in rejected_rows(raw, PROJECTS).collect()] == ["q"]


def test_dates_in_several_formats(spark):
    raw = spark.createDataFrame([("1", "2020-03-04"), ("2", "2020-03-04 05:06:07"), ("3", "03/04/2020"),
                                 ("4", "25/04/2020"), ("5", "soon"), ("6", None)], "id string, start_date string")
    rows = {r.project_id: r.start_date for r in normalize(raw, PROJECTS)[0].collect()}
    assert rows["1"] == dt.datetime(2020, 3, 4) and rows["2"] == dt.datetime(2020, 3, 4, 5, 6, 7)
    # One format for the column: 25/04 rules out month first, so 03/04 is the third of April.
    assert rows["3"] == dt.datetime(2020, 4, 3) and rows["4"] == dt.datetime(2020, 4, 25)
    assert rows["5"] is None and rows["6"] is None


def test_row_ids_and_extra_columns(spark):
    raw = spark.createDataFrame([("a", "h", 1), ("b", None, 2)], "id string, phash string, other int")
    df, _ = normalize(raw, IMAGES, keep_extra=True)
    rows = df.collect()
    assert all(r.image_id is not None for r in rows) and len({r.image_id for r in rows}) == 2
    assert [r.image_hash for r in rows] == ["h", ""] and [r.other for r in rows] == [1, 2]


def test_csv_directory(spark, tmp_path):
    (tmp_path / "projects.csv").write_text(
        'Project Code,Work Name,Expenditure,District Name\n 1 ,"Road, ""A""",NA,North\n2,None,5,\n')
    (tmp_path / "images.csv").write_text("img_id,proj_id,hash\n,1,aa\n5,1,aa\n")
    data = load_dataset(spark, str(tmp_path))
    rows = {r.project_id: r for r in data.projects.collect()}
    assert rows["1"].project_name == 'Road, "A"' and rows["1"].utilized_amount is None
    assert rows["2"].project_name == "" and rows["2"].utilized_amount == 5.0 and rows["2"].district == ""
    assert data.images.where("image_id is null").count() == 1
    assert data.files == {"projects": True, "documents": False, "images": True, "inspections": False}
    assert probe_files(spark, str(tmp_path)) == data.files
    assert load_evidence(spark, str(tmp_path), "documents") is None


def test_project_images_come_before_images(spark, tmp_path):
    (tmp_path / "images.csv").write_text("id,hash\n1,late\n")
    (tmp_path / "project_images.csv").write_text("id,hash\n1,first\n")
    assert load_evidence(spark, str(tmp_path), "images").first().image_hash == "first"


def test_parquet_and_missing_and_excel(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path))
    spark.range(3).select(F.col("id")).write.parquet(str(tmp_path / "projects.parquet"))
    assert load_dataset(spark, str(tmp_path)).projects.count() == 3
    with pytest.raises(ValueError):
        read_table(spark, "a.xlsx")


def test_documents_have_their_own_synonyms():
    assert resolve_headers(["doc_id", "id", "claimed_amount", "text", "site_location"], DOCUMENTS) == {
        "document_id": 0, "project_id": 1, "amount": 2, "extracted_text": 3, "location": 4}


def test_records(spark, tmp_path):
    df = spark.sql("select 'a' as id, cast(null as double) as x, timestamp'2020-01-02 03:04:05' as at")
    assert json.loads(to_records(df).first().record) == {"id": "a", "x": None, "at": "2020-01-02T03:04:05.000"}
    write_records(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().at.startswith("2020-01-02T03:04:05")


def test_plan_reads_only_the_needed_columns(spark, tmp_path):
    spark.range(5).selectExpr("id as project_id", "id as lat", "'x' as name", "1.0 as expenditure").write.parquet(
        str(tmp_path / "projects.parquet"))
    df = load_dataset(spark, str(tmp_path)).projects.select("project_id", "utilized_amount")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<project_id:bigint,expenditure:decimal" in plan


def test_blank_ids_and_any_white_space(spark):
    raw = spark.createDataFrame([("\tP1\u00a0", "x"), ("", "y"), (" \t", "z"), (None, "w")], "id string, project_name string")
    rows, _ = normalize(raw, PROJECTS)
    assert [r.project_id for r in rows.collect()] == ["P1"]
    assert sorted(r.project_name for r in rejected_rows(raw, PROJECTS).collect()) == ["w", "y", "z"]
