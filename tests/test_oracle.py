"""Every registered query against its SQL text on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import check_oracle
from worksight.testing import catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Build the canonical tables and each kind of risk table once per module."""
    patch, kept = pytest.MonkeyPatch(), {}
    dataset, assess = catalog.B.dataset, catalog.assess

    def one_dataset(spark, sf_dir, without=()):
        key = ("data", sf_dir, without)
        if key not in kept:
            kept[key] = dataset(spark, sf_dir, without)
        return kept[key]

    def one_assessment(data, as_of=None, include_ml=True, evidence="full"):
        key = (id(data), include_ml, evidence)
        if key not in kept:
            kept[key] = assess(data, as_of, include_ml, evidence).stored()
        return kept[key]

    patch.setattr(catalog.B, "dataset", one_dataset)
    patch.setattr(catalog, "assess", one_assessment)
    yield
    patch.undo()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(got) and check_oracle.difference(got, duck.execute(ORACLE[name]).df()) is None


def test_full_fusion_with_the_forest(spark):
    rows = QUERIES["risk_fusion_with_ml"](spark, SF_DIR).collect()
    assert len(rows) == 1500 and len({r.project_id for r in rows}) == 1500
    assert abs(sum(r.ml_anomaly for r in rows) - 75) <= 2
    assert all(0 <= r.overall_risk_score <= 100 and r.risk_reasons for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert "investigation_rank" in df.columns and df.count() == 1500
