from collections import Counter

import pytest

from worksight.operators import evidence as E
from worksight.sources import DOCUMENTS, IMAGES, INSPECTIONS, normalize


def docs(spark, *rows):
    return normalize(spark.createDataFrame(
        rows, "document_id string, project_id string, amount double, contractor string, location string"), DOCUMENTS)[0]


def images(spark, *rows):
    return normalize(spark.createDataFrame(
        rows, "image_id string, project_id string, image_hash string, similarity_score double, status string"),
        IMAGES)[0]


def inspections(spark, *rows):
    return normalize(spark.createDataFrame(
        rows, "inspection_id string, project_id string, inspection_score double, inspection_status string"),
        INSPECTIONS)[0]


def test_documents(spark, make_projects):
    projects = make_projects(dict(contractor=" Acme", district="North", utilized_amount=100.0),
                             dict(contractor="B", district="South"), dict(contractor="C"))
    got = E.verify_documents(projects, docs(
        spark, ("1", "P0", 101.0, "ACME ", "North, X"), ("2", "P0", 101.5, "", "west"), ("3", "P1", 5.0, "b", None)))
    rows = {(r.project_id, r.document_id): r for r in got.collect()}
    assert len(rows) == 4
    good, bad, other, none = rows["P0", "1"], rows["P0", "2"], rows["P1", "3"], rows["P2", None]
    assert not good.document_anomaly and good.document_risk_score == 0.0
    assert bad.amount_mismatch and bad.contractor_mismatch and bad.location_mismatch
    assert bad.document_risk_score == 90.0
    assert not other.document_anomaly                     # no amount on record, no location in the file
    assert none.missing_document and none.document_risk_score == 30.0 and not none.document_exists
    rolled = {r.project_id: r for r in E.document_rollup(projects, docs(
        spark, ("1", "P0", 101.0, "acme", "North"), ("2", "P0", 101.5, "", "west"))).collect()}
    assert list(rolled) == ["P0"] and rolled["P0"].document_risk_score == 90.0 and rolled["P0"].document_anomaly


def test_images(spark, make_projects):
    projects = make_projects({}, {}, {}, {})
    table = images(spark, ("1", "P0", "h", 0.5, "Valid"), ("2", "P1", "h", 0.9, "Potentially Reused "),
                   ("3", "P2", "", 0.1, None), ("4", "P2", None, None, ""))
    rows = {(r.project_id, r.image_id): r for r in E.verify_images(projects, table).collect()}
    assert rows["P0", "1"].reused_image and rows["P0", "1"].image_risk_score == 50.0
    assert rows["P1", "2"].image_risk_score == 100.0 and rows["P1", "2"].high_similarity
    assert not rows["P2", "3"].image_anomaly and rows["P2", "4"].similarity_score == 0.0
    assert rows["P3", None].missing_image and rows["P3", None].image_risk_score == 30.0
    assert rows["P3", None].similarity_score == 0.0
    counted = {r.image_id: r.reused_image for r in E.verify_images(projects, table, count_empty=True).collect()}
    assert counted["3"] and counted["4"] and not counted[None]


def test_one_hash_on_a_third_of_all_images(spark, make_projects):
    table = spark.range(3000).selectExpr(
        "cast(id as string) as image_id", "concat('P', id % 3) as project_id",
        "case when id % 3 = 0 then 'same' else cast(id as string) end as image_hash")
    table = normalize(table, IMAGES)[0]
    assert [tuple(r) for r in E.image_hash_reuse(table).collect()] == [("same", 1000)]
    got = {r.project_id: r.reused_image for r in E.image_rollup(table).collect()}
    assert got == {"P0": True, "P1": False, "P2": False}


@pytest.mark.parametrize("value, status, want", [
    (50.0, "Passed", 0.0), (49.9, "Passed", 30.0), (60.0, "FAILED", 50.0), (10.0, "failed", 80.0),
    (60.0, "needs improvement", 25.0), (60.0, " failed", 0.0), (None, None, 0.0)])
def test_inspections(spark, make_projects, value, status, want):
    got = E.analyze_inspections(make_projects({}), inspections(spark, ("1", "P0", value, status))).first()
    assert got.inspection_risk_score == want and got.inspection_anomaly == (want > 0)


def test_no_inspection_of_a_project(spark, make_projects):
    got = E.analyze_inspections(make_projects({}), inspections(spark, ("1", "other", 1.0, "failed"))).collect()
    assert len(got) == 1 and got[0].missing_inspection and got[0].inspection_risk_score == 30.0


def test_no_file_flags_nothing(make_projects):
    projects = make_projects({}, {})
    for check, name in ((E.verify_documents, "document"), (E.verify_images, "image"),
                        (E.analyze_inspections, "inspection")):
        rows = check(projects, None).collect()
        assert len(rows) == 2
        assert not any(r[f"{name}_anomaly"] or r[f"{name}_signal_available"] or r[f"{name}_risk_score"] for r in rows)


def test_a_third_of_all_documents_on_one_project(spark, make_projects):
    projects = make_projects(*[dict(contractor="A", utilized_amount=1.0) for _ in range(50)])
    raw = spark.range(3000).selectExpr(
        "id as document_id", "case when id % 3 = 0 then 'P0' else concat('P', id % 50) end as project_id",
        "case when id = 999 then 5.0D else 1.0D end as amount", "'A' as contractor")
    documents = normalize(raw, DOCUMENTS)[0]
    plain = sorted(map(tuple, E.document_rollup(projects, documents).collect()))
    assert plain == sorted(map(tuple, E.document_rollup(projects, documents, rows_per_task=40).collect()))
    assert [r[0] for r in plain if r[1]] == ["P0"]
    rows = E.verify_documents(projects, documents, rows_per_task=40)
    assert rows.count() == 3000 and rows.where("amount_mismatch").count() == 1


def test_few_reused_hashes_are_sent_to_the_images(spark):
    images = spark.range(3000).selectExpr("concat('P', id % 500) as project_id", "concat('i', id) as image_id",
                                          "case when id % 4 = 0 then '' else concat('h', id % 2900) end as image_hash",
                                          "0.1D as similarity_score", "'Valid' as status")
    for count_empty in (False, True):
        found = E.image_rollup(images, count_empty)
        assert "hashpartitioning(image_hash" not in found._jdf.queryExecution().executedPlan().toString()
        reused = {r.project_id for r in found.where("reused_image").collect()}
        by_hash = Counter(r.image_hash for r in images.collect() if count_empty or r.image_hash)
        assert reused == {r.project_id for r in images.collect() if by_hash[r.image_hash] > 1}
