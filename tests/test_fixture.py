"""The bound tables must let rules both fire and rest, or a constant would pass the oracle."""

from pathlib import Path

import pytest

import check_oracle
from worksight.operators.alerts import FLAG_ALERT, GENERAL_ALERT, LEVEL_ALERT
from worksight.operators.explain import TEXT
from worksight.operators.evidence import DOCUMENT_FLAGS, IMAGE_FLAGS, INSPECTION_FLAGS
from worksight.testing import bindings, catalog
from worksight.testing.oracle import compose

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def table():
    con = check_oracle.connect(SF_DIR)
    con.execute("create table alerts as " + compose("select * from alert_table"))
    return con


def values(con, column):
    return {r[0] for r in con.execute(f"select distinct {column} from alerts").fetchall()}


@pytest.mark.parametrize("column", [*catalog.FLAGS, *DOCUMENT_FLAGS, *IMAGE_FLAGS, *INSPECTION_FLAGS,
                                    "sharp_signal_fired", "alert_required"])
def test_flags_take_both_values(table, column):
    # the forest takes no part in this table
    assert values(table, column) == ({False} if column == "ml_anomaly" else {True, False})


def test_levels_and_priorities_all_occur(table):
    assert values(table, "risk_level") == {"LOW", "MEDIUM", "HIGH", "CRITICAL"}
    assert values(table, "alert_severity") == {"NONE", "MEDIUM", "HIGH", "CRITICAL"}
    assert {p[:2] for p in values(table, "priority")} == {"P1", "P2", "P3", "P4", "P5"}


def test_alert_types_occur(table):
    seen = values(table, "alert_type_by_flag")
    assert {GENERAL_ALERT, *LEVEL_ALERT.values()} <= seen
    assert {label for s, label in FLAG_ALERT if s not in ("ml_anomaly", "geo")} <= seen


def test_reasons_occur(table):
    said = table.execute("select string_agg(distinct risk_reasons, ' | ') from alerts").fetchone()[0]
    unseen = {key for key, sentence in TEXT.items() if sentence.split("%")[0].rstrip(" (") not in said}
    # words of the forest, and those for evidence whose details are unknown
    assert unseen <= {"ml", "ml_profile", "image", "delay", "progress"}, unseen


def test_duplicate_scores_vary(table):
    low, between, high = table.execute(
        "select count(*) filter (duplicate_risk_score = 0), count(*) filter (duplicate_risk_score > 0 and "
        "duplicate_risk_score < 100), count(*) filter (duplicate_risk_score = 100) from alerts").fetchone()
    assert low > 500 and between > 50 and high > 50


def test_views_read_whole_tables(spark):
    read = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    for name in ("evidence_documents", "evidence_images", "inspections"):
        assert bindings.view(spark, SF_DIR, name).count() == read
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert bindings.view(spark, SF_DIR, "projects").count() == 1500 and parts <= 1500
