"""Stored risk tables, row numbers, sketches and scored pairs against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from worksight.functions.vectors import dots
from worksight.operators import alerts as A, duplicates as D, reports as R
from worksight.plans import serving
from worksight.plans.quantiles import approximate_quantiles, exact_quantiles
from worksight.sources.schema import IMAGES, normalize

WORDS = ["Road", "Bridge", "School", "Hall", "É", "ab", "a%b_c", ""]


@pytest.fixture(scope="module")
def risk(spark):
    text = {x for x in [*A.DETAIL_COLUMNS, *A.SEARCHED] if x not in ("project_id",)}
    rows = spark.range(3000).select(F.concat(F.lit("P"), "id").alias("project_id"), *[
        (F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.xxhash64("id", F.lit(x)), F.lit(len(WORDS))) + 1).cast("int"))
         if x in ("project_name", "district", "mp_name", "contractor") else F.lit(None).cast("string") if x != "risk_level"
         else F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW")).alias(x) for x in sorted(text)
        if x not in ("overall_risk_score", "risk_signal_count")],
        (F.col("id") % 97).cast("double").alias("overall_risk_score"), (F.col("id") % 5).alias("risk_signal_count"))
    return rows


@pytest.fixture(scope="module")
def store(risk, tmp_path_factory):
    return serving.RiskStore.write(risk, str(tmp_path_factory.mktemp("serving") / "store"))


@pytest.mark.parametrize("text", ["", "ro", "road", " BRIDGE ", "hall\nschool", "a%b", "nothing here", "p29", "P2999", "é"])
@pytest.mark.parametrize("level", ["ALL", "HIGH"])
def test_search_answers_as_without_lists(risk, store, text, level):
    want = [r.project_id for r in A.search_projects(risk, text, level, None).collect()]
    assert [r.project_id for r in store.search(text, level, None).collect()] == want
    assert [r.project_id for r in store.search(text, level).collect()] == want[:200]


def test_many_candidates_are_joined(risk, store, monkeypatch):
    monkeypatch.setattr(serving, "FILTERED_IDS", 10)
    found = store.search("road", limit=None)
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    assert [r.project_id for r in found.collect()] == [r.project_id for r in A.search_projects(risk, "road", limit=None).collect()]


def test_lookup_reaches_the_scan(risk, store):
    found = store.detail(" P77 ")
    assert "EqualTo(project_id,P77)" in found._jdf.queryExecution().toString()
    assert found.collect() == A.project_detail(risk, "P77").collect() and store.detail("P_").count() == 0


def test_grams(spark):
    df = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(serving.grams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], [], []]


def test_row_numbers_do_not_depend_on_partitions(spark):
    rows = [("P1", "h", 0.5, "x"), ("P1", "h", 0.5, "x"), ("P0", None, None, None), ("P2", "", 0.1, "y")] * 50
    df = spark.createDataFrame(rows, "project_id string, image_hash string, similarity_score double, status string")
    tables = [sorted(map(tuple, normalize(df.repartition(n), IMAGES)[0].collect()), key=str) for n in (1, 7)]
    assert tables[0] == tables[1]
    at = IMAGES.canonical.index("image_id")
    assert sorted(int(r[at]) for r in tables[0]) == list(range(1, 201))
    assert all(r[IMAGES.canonical.index("project_id")] == "P0" for r in tables[0] if int(r[at]) <= 50)


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_sketch_keeps_its_rank_error(spark, error):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.full(1000, 0.25), rng.exponential(50, 2000)])
    df = spark.createDataFrame([(float(v), None) for v in x], "a double, b double").repartition(5)
    for q in (0.05, 0.5, 0.9):
        got = approximate_quantiles(df, ["a", "b"], q, error)
        low, high = (x < got["a"]).mean(), (x <= got["a"]).mean()
        assert low - error <= q <= high + error and got["b"] is None
    assert exact_quantiles(df, ["a"], 0.5)["a"] == pytest.approx(np.median(x))
    plan = df.agg(F.percentile_approx("a", 0.5, 100))._jdf.queryExecution().toString()
    assert plan.count("Scan") <= 4


def test_dots_of_sparse_vectors():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    ids, weights = [], []
    for n in (0, 1, 5, 40, 200):
        ids.append(sorted(rng.choice(300, n, replace=False).tolist()))
        weights.append(rng.normal(size=n).tolist())
    one = [i for i in range(5) for _ in range(5)]
    two = [i % 5 for i in range(25)]
    lists = [pa.array([v[i] for i in at], pa.list_(t)) for at in (one, two) for v, t in ((ids, pa.int64()), (weights, pa.float64()))]
    dense = np.zeros((5, 300))
    for i in range(5):
        dense[i, ids[i]] = weights[i]
    want = [dense[a] @ dense[b] for a, b in zip(one, two)]
    assert np.allclose(dots(*lists), want)
    sliced = dots(*(x.slice(7, 11) for x in lists))
    assert np.allclose(sliced, want[7:18])


def test_repeated_rows_do_not_multiply_named_pairs(spark):
    rows = [("P1", "north bridge repair", "x"), ("P1", "north bridge repair", "x"), ("P2", "north bridge repair", "x"),
            ("P3", "south school roof", "x"), ("P4", "lake pump house", "x")]
    df = spark.createDataFrame(rows, "project_id string, project_name string, project_type string")
    got = sorted(tuple(r) for r in D.duplicate_pairs(df, name="project_name").select(
        "project_id_1", "project_name_1", "project_id_2", "project_name_2").collect())
    assert got == [("P1", "north bridge repair", "P2", "north bridge repair")] * 2       # one for each row of P1


def test_unknown_project_and_project_without_reports(spark):
    ids = spark.createDataFrame([(" P1",), ("P2",), ("P9",), (None,), ("P1",)], "project_id string")
    projects = spark.createDataFrame([("P1",), ("P2",), ("P2",)], "project_id string")
    reports = spark.createDataFrame([("P1",), ("P1",)], "project_id string")
    assert sorted(map(tuple, R.report_status(ids, projects, reports).collect())) == [("P1", True, 2), ("P2", True, 0), ("P9", False, 0)]
