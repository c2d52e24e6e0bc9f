"""What is no longer read does not stay on disk."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from worksight.operators import alerts as A, duplicates as D
from worksight.plans.colocated import ColocatedStore
from worksight.plans.materialize import FILE_CLEANUP, discard, materialize, scratch_dir, shuffles_removed
from worksight.plans.pipeline import assess
from worksight.plans.serving import RiskStore
from worksight.sources.readers import Dataset
from worksight.streaming import maintained as M, refresh


def shuffle_files(spark):
    names = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")]
    return {x for x in names if "shuffle_" in x}


def scratch(spark):
    folder = Path(scratch_dir(spark).removeprefix("file:")) / "worksight"
    return set(folder.iterdir()) if folder.exists() else set()


def some_docs(spark):
    return spark.range(60).selectExpr("id", "concat('hall', id % 20, ' ward', id % 20, ' bridge', id % 20, ' gate', id % 30) as body")


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(3, "count"), "small")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 10


def test_the_setting_of_the_session_returns(spark):
    own = spark.conf.get(FILE_CLEANUP)
    first, second = shuffles_removed(spark), shuffles_removed(spark)
    first.__enter__(), second.__enter__(), first.__exit__(None, None, None)
    assert spark.conf.get(FILE_CLEANUP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(FILE_CLEANUP) == own


def test_a_discarded_table_is_gone(spark):
    before = scratch(spark)
    kept, gone = (materialize(spark.range(5), x) for x in ("kept", "gone"))
    discard(gone)
    assert [x.name.split("-")[0] for x in scratch(spark) - before] == ["kept"] and kept.count() == 5


@pytest.mark.parametrize("query", [D.similar_texts, D.duplicate_pairs, D.duplicate_risk, D.duplicate_hits])
def test_terms_do_not_outlive_their_vectors(spark, query):
    before, docs = scratch(spark), some_docs(spark)
    found = query(docs, "id", text=F.col("body"), stop_words=())
    labels = {x.name.rsplit("-", 1)[0] for x in scratch(spark) - before}
    assert "tfidf" in labels and not labels & {"term-counts", "shared-terms"}
    assert found.count() > 0


def test_narrow_vectors_keep_weights_and_bounds(spark):
    docs = some_docs(spark)
    _, _, terms = D._prepare(docs, "id", F.col("body"), (), 5, 0.55)
    counted = D.count_terms(D.text_groups(D.text_members(docs, "id", F.col("body"), ())))
    want = D.shared_vectors(counted, D.shared_terms(counted), F.lit(60)).where(F.col("rest_with") >= 0.55)
    # a term has another number in the other table, so the terms of a text are compared as a whole
    weights = {r["group"]: r.w for r in terms.where("rest_with >= 0.55").groupBy("group").agg(F.array_sort(F.collect_list("weight")).alias("w")).collect()}
    assert weights == {r["group"]: pytest.approx(r.w) for r in want.groupBy("group").agg(F.array_sort(F.collect_list("weight")).alias("w")).collect()}
    bounds = [terms.where("rest_with >= 0.55").agg(F.sum("rest_with")).first()[0], want.agg(F.sum("rest_with")).first()[0]]
    assert bounds[1] <= bounds[0] <= bounds[1] * (1 + 3e-7)


def test_as_many_frequent_terms_as_can_be_sent_are_sent(spark, monkeypatch):
    shared = spark.range(1, 2001).select(F.col("id").alias("holders"))
    monkeypatch.setattr(D, "BROADCAST_KEYS", 700)
    least = D._frequent_from(shared)
    assert 350 <= shared.where(F.col("holders") > least).count() <= 700
    monkeypatch.setattr(D, "BROADCAST_KEYS", 5000)
    assert D._frequent_from(shared) == D.FREQUENT


@pytest.fixture
def no_broadcast_by_size(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("most", [100, 0])
def test_rows_without_a_change_do_not_move(spark, tmp_path, monkeypatch, no_broadcast_by_size, most):
    monkeypatch.setattr(M, "SENT_KEYS", most)
    schema = spark.createDataFrame([], "k string, v long").schema
    start = spark.range(500).selectExpr("concat('k', id) as k", "id as v").unionByName(
        spark.createDataFrame([(None, 7), ("twice", 1), ("twice", 1)], schema))
    table = M.MaintainedTable(str(tmp_path / "t"), "k", schema).start(start)
    table.apply(spark.createDataFrame([("k3", -3), (None, -7), ("new", -1)], schema), 0)
    table.apply(spark.createDataFrame([("k3", -4)], schema), 1)
    got, seen = table.current(spark), table.current(spark).collect()
    want = {f"k{i}": i for i in range(500)} | {None: -7, "twice": 1, "new": -1, "k3": -4}
    assert dict(map(tuple, seen)) == want and len(seen) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("LeftAnti" in plan and "LeftSemi" in plan) == (most > 0)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == (3 if most else 1)     # keys, twice; rows of several


def test_few_rescored_projects_are_sent_to_the_assessment(spark, make_projects, monkeypatch, no_broadcast_by_size):
    columns = dict.fromkeys(("project_name", "contractor", "sanctioned_amount"), True)
    rows = make_projects(*[dict(project_id=f"P{i}", project_name=f"road {i}", sanctioned_amount=1.0) for i in range(8)])
    assessed = assess(Dataset(rows, availability=columns), F.lit("2024-01-01").cast("date"), include_ml=False).stored()
    counts = spark.createDataFrame([("P1", 2), ("P9", 1)], "project_id string, citizen_report_count long")
    plans = []
    for most in (100, 0):
        monkeypatch.setattr(refresh, "SENT_KEYS", most)
        got = refresh.rescore(assessed, counts)
        assert [(r.project_id, r.citizen_report_count, r.citizen_anomaly) for r in got.collect()] == [("P1", 2, True)]
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_an_index_leaves_one_copy_of_its_rows(spark, tmp_path):
    text = [x for x in dict.fromkeys([*A.DETAIL_COLUMNS, *A.SEARCHED]) if x not in ("project_id", "overall_risk_score")]
    risk = spark.range(50).select(F.format_string("P%03d", "id").alias("project_id"), F.lit(1.0).alias("overall_risk_score"),
                                  *[F.lit("road works").alias(x) for x in text])
    before = scratch(spark)
    store = RiskStore.write(risk, str(tmp_path / "store"))
    assert not {x.name.split("-")[0] for x in scratch(spark) - before} & {"to", "grams"}
    assert store.risk().count() == 50 and store.search("P003", "ALL").count() == 1


@pytest.mark.parametrize("limit", [2, 100])
def test_evidence_is_computed_once_for_its_buckets(spark, make_projects, tmp_path, limit):
    seen = spark.sparkContext.accumulator(0)

    def grade(i):
        seen.add(1)
        return "Failed" if i % 3 == 0 else "Passed"

    projects = make_projects(*[dict(project_id=f"P{i}") for i in range(10)])
    rows = spark.range(0, 40, 1, 2).select(
        F.col("id").alias("inspection_id"), F.when(F.col("id") < 38, F.concat(F.lit("P"), F.col("id") % 10 % F.lit(7))).alias("project_id"),
        F.lit(60.0).alias("inspection_score"), F.udf(grade, T.StringType())("id").alias("inspection_status"),
        F.lit("2024-01-01").cast("date").alias("inspection_date"))
    before = scratch(spark)
    store = ColocatedStore.write(Dataset(projects, inspections=rows, availability={}), str(tmp_path / "store"), 3, limit)
    assert seen.value == 40
    assert scratch(spark) == before
    assert sorted(store.dataset().inspections.collect(), key=str) == sorted(rows.collect(), key=str)
