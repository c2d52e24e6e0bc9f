"""Tables kept by many micro-batches against one batch over everything."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from worksight.operators import reports as R
from worksight.plans.pipeline import assess
from worksight.sources.readers import Dataset
from worksight.streaming import count_stream, current_counts, run_now, write_counts
from worksight.streaming.maintained import MaintainedTable
from worksight.streaming.refresh import alert_table, maintain_alerts, rescore

REPORT = "report_id long, project_id string"


def arrivals(spark, folder, batches):
    for i, ids in enumerate(batches):
        spark.createDataFrame([(100 * i + k, p) for k, p in enumerate(ids)], REPORT).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(folder)


def test_fifty_batches_leave_few_files(spark, tmp_path):
    batches = [[f"P{(i * 7 + k) % 11}" for k in range(1 + i % 3)] + ["HOT"] for i in range(50)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    query = write_counts(count_stream(arrivals(spark, source, batches)), f"{out}/counts", f"{out}/cp", available_now=True,
                         compact_every=4)
    run_now(query)
    assert query.lastProgress["batchId"] >= 49
    want = sorted(map(tuple, R.citizen_risk(spark.read.parquet(source)).collect()))
    assert sorted(map(tuple, current_counts(spark, f"{out}/counts").collect())) == want
    folders = [x for x in Path(f"{out}/counts").glob("*/slot=*")]
    assert len(folders) <= 2 * 4 + 2
    assert len(list(Path(f"{out}/counts").rglob("*.parquet"))) <= len(folders) * 4


def test_repeated_batches_and_interrupted_compaction(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v long").schema
    table = MaintainedTable(str(tmp_path / "t"), "k", schema, every=2).start(spark.createDataFrame([("a", 0), ("z", 0)], schema))
    state = {"a": 0, "z": 0}
    for n in range(9):
        change = {"a": n + 1, f"b{n % 3}": n}
        for _ in range(1 + n % 2):                        # every second batch comes twice
            table.apply(spark.createDataFrame(list(change.items()), schema), n)
        state |= change
        assert dict(map(tuple, table.current(spark).collect())) == state
    assert dict(map(tuple, MaintainedTable(table.path, "k", schema, 2).start(spark=spark).current(spark).collect())) == state
    # a base folder that was lost while it was being rewritten
    newest = 9 // 2 % 2
    spark.createDataFrame([], table._stored).write.mode("overwrite").parquet(f"{table.path}/base/slot={newest}")
    assert dict(map(tuple, table.current(spark).collect())) == state


@pytest.fixture(scope="module")
def data(spark):
    from tests.conftest import NAMES, PROJECT_SCHEMA
    from worksight.sources import PROJECTS, normalize
    rows = [tuple({"project_id": f"P{i}", "project_name": f"Road {i}", "contractor": f"C{i % 3}", "status": "Delayed" if i % 4 == 0 else "Open",
                   "sanctioned_amount": 100.0, "released_amount": 120.0 if i % 5 == 0 else 50.0, "utilized_amount": 40.0,
                   "completion_percentage": 30.0}.get(n) for n in NAMES) for i in range(30)]
    projects, availability = normalize(spark.createDataFrame(rows, PROJECT_SCHEMA), PROJECTS)
    return Dataset(projects, availability=availability)


def test_maintained_alerts_equal_a_full_assessment(spark, data, tmp_path):
    as_of = F.lit("2024-01-01").cast("date")
    base = assess(data, as_of, include_ml=False).stored()
    batches = [["P1", "P1", "P2"], ["P3"], ["P1", "P5"], ["P29", "P3", "P3", "P3"], ["nobody"], ["P7"]]
    source = str(tmp_path / "in")
    stream = arrivals(spark, source, batches)
    table, emitted = alert_table(base, str(tmp_path / "alerts"), every=2), []
    run_now(maintain_alerts(count_stream(stream), base, table, str(tmp_path / "cp"), available_now=True,
                            emit=lambda df, n: emitted.extend((n, r.project_id, r.alert_type) for r in df.collect())))
    data.citizen_reports = spark.read.parquet(source)
    full = assess(data, as_of, include_ml=False).risk.select(*base.risk.columns)
    key = lambda r: r.project_id
    assert sorted(table.current(spark).collect(), key=key) == sorted(full.collect(), key=key)
    assert emitted and {p for _, p, _ in emitted} <= {p for b in batches for p in b}
    one = rescore(base, spark.createDataFrame([("P7", 1)], "project_id string, citizen_report_count long")).collect()
    assert [r.project_id for r in one] == ["P7"] and one[0].citizen_anomaly
