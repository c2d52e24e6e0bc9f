import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("worksight-tests")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="worksight-"))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


PROJECT_SCHEMA = ("project_id string, project_name string, state string, district string, mp_name string, "
                  "project_type string, contractor string, agency string, status string, sanctioned_amount double, "
                  "released_amount double, utilized_amount double, completion_percentage double, "
                  "financial_progress_ratio double, latitude double, longitude double, sanction_date string, "
                  "start_date string, expected_completion_date string, actual_completion_date string")
NAMES = [f.split()[0] for f in PROJECT_SCHEMA.split(", ")]


@pytest.fixture
def make_projects(spark):
    """Canonical projects from dicts of the columns that matter."""
    from worksight.sources import PROJECTS, normalize

    def build(*rows):
        data = [tuple(r.get(n, f"P{i}" if n == "project_id" else None) for n in NAMES) for i, r in enumerate(rows)]
        return normalize(spark.createDataFrame(data, PROJECT_SCHEMA), PROJECTS)[0]
    return build
