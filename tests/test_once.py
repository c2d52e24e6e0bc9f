"""Sorted lists and stored tables assess the projects once, and hold no more than is read."""

from pyspark.sql import functions as F, types as T

from worksight.functions.columns import not_blank, strip
from worksight.functions.geo import grid_cell
from worksight.operators import alerts as A, insights as I
from worksight.operators.evidence import document_rollup
from worksight.operators.proximity import near_sites
from worksight.plans.pipeline import Assessment
from worksight.plans.serving import RiskStore
from worksight.sources.schema import DOCUMENTS, IMAGES, INSPECTIONS, normalize
from worksight.testing import bindings as B

ROWS = 4000


def counted_risk(spark):
    """A risk table, and how often its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def score(i):
        seen.add(1)
        return float(i % 97)

    text = [x for x in dict.fromkeys([*A.DETAIL_COLUMNS, *A.ALERT_COLUMNS, *A.HIGH_RISK_COLUMNS, *A.SEARCHED])
            if x not in ("project_id", "overall_risk_score", "risk_signal_count", "risk_level")]
    rows = spark.range(0, ROWS, 1, 4).select(
        F.format_string("P%05d", "id").alias("project_id"), F.udf(score, T.DoubleType())("id").alias("overall_risk_score"),
        (F.col("id") % 5).alias("risk_signal_count"), F.lit("HIGH").alias("risk_level"), F.lit(True).alias("alert_required"),
        *[F.lit("road works").alias(x) for x in text])
    return rows, seen


def in_order(rows):
    return [r.project_id for r in sorted(rows.collect(), key=lambda r: (-r.overall_risk_score, -r.risk_signal_count, r.project_id))]


def test_lists_compute_their_rows_once(spark):
    for listing in (A.alert_feed, A.high_risk):
        risk, seen = counted_risk(spark)
        got = [r.project_id for r in listing(risk).collect()]
        assert seen.value == ROWS
        assert got == in_order(risk)


def test_index_computes_its_rows_once_and_lists_blocks(spark, tmp_path):
    risk, seen = counted_risk(spark)
    store = RiskStore.write(risk, str(tmp_path / "store"))
    assert seen.value == ROWS
    assert "_block" not in store.risk().columns and store.risk().count() == ROWS
    per_project = ROWS * len({t[i:i + 3] for t in ["road works"] for i in range(len(t) - 2)})
    assert store._table("grams").count() < per_project / 4
    assert [r.project_id for r in store.search("P0017", limit=None).collect()] == in_order(risk.where("project_id like 'P0017%'"))
    assert store.search("road works", limit=None).count() == ROWS and store.search("road P", limit=None).count() == 0


def test_places_in_a_cell_are_found_once(spark):
    places = spark.range(10).select((F.col("id") / 1e3).alias("latitude"), (F.col("id") / 1e3).alias("longitude"), F.lit(1).alias("projects"))
    found = near_sites(places.withColumn("cell", grid_cell(F.col("latitude"), F.col("longitude"), 0.3)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(steps) == 1 and "COS" not in steps[0].upper()
    assert found.count() == 9 and "_inside_0" not in "".join(found.columns)


def test_stored_holds_what_is_read(spark):
    risk, _ = counted_risk(spark)
    table = Assessment(risk, {}).stored("project_id", "overall_risk_score").risk
    assert table.columns == ["project_id", "overall_risk_score"] and table.count() == ROWS
    assert {"project_id", "alert_required", "status", "contractor"} <= set(I.READ_COLUMNS)


def test_blank_text(spark):
    rows = spark.createDataFrame([(x,) for x in ("", " ", "a", " a", "\u3000\u00a0", "\u200b", "\n\t", "\u2028b", None)], "x string")
    x = F.col("x")
    assert rows.where(~not_blank(x).eqNullSafe(strip(x) != "")).count() == 0


def test_evidence_is_joined_once(spark, tmp_path):
    """Images and inspections are scans of one stored join; documents lie ready for the join by project."""
    tables = {
        "region": spark.sql("select 0 as r_regionkey, 'ASIA' as r_name"),
        "nation": spark.sql("select 0 as n_nationkey, 'INDIA' as n_name, 0 as n_regionkey"),
        "customer": spark.sql("select id as c_custkey, concat('Customer#', lpad(id, 9, '0')) as c_name, 0 as c_nationkey, 'A' as c_mktsegment from range(10)"),
        "part": spark.sql("select id as p_partkey, 'ring' as p_name, 'LARGE' as p_type from range(7)"),
        "events": spark.sql("select id as event_id, timestamp'2024-01-01' as ts, id as user_id, 'view' as event_type, 1d as value, '' as props from range(3)"),
        "orders": spark.sql("select if(id = 11, null, id) as o_orderkey, id % 10 as o_custkey, 'F' as o_orderstatus, 100d + id as o_totalprice, timestamp'1998-02-06' as o_orderdate, '5-LOW' as o_orderpriority from range(40) union all select 3, 3, 'F', 103d, timestamp'1998-02-06', '5-LOW'"),
        "lineitem": spark.sql("select if(id = 5, null, id % 45) as l_orderkey, id % 123 as l_partkey, id % 9 as l_suppkey, cast(id % 7 as int) as l_linenumber, 5d as l_quantity, 0.05d as l_discount, 0.02d as l_tax, if(id % 3 = 0, 'R', 'N') as l_returnflag, 'F' as l_linestatus, timestamp'1998-03-06' as l_shipdate from range(300)"),
    }
    for name, table in tables.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    data = B.dataset(spark, str(tmp_path))
    for name, spec, got in (("evidence_images", IMAGES, data.images), ("inspections", INSPECTIONS, data.inspections),
                            ("evidence_documents", DOCUMENTS, data.documents)):
        want = normalize(B.view(spark, str(tmp_path), name), spec)[0]
        assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 250
    for table in (data.images, data.inspections):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = document_rollup(data.projects, data.documents)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 3      # lines, their projects, the projects to compare with
