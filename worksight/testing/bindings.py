"""Canonical tables derived from the driver's test tables.

Each view is one SQL text that gives the same rows on Spark and on the SQL
oracle.  ``dataset`` builds the frames; ``with_views`` wraps an oracle query.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.materialize import materialize
from ..sources.readers import Dataset
from ..sources.schema import DOCUMENTS, IMAGES, INSPECTIONS, PROJECTS, normalize

AS_OF = "2002-01-01"

VIEWS = {
    "line_agg": """
select l_orderkey,
       floor(sum(case when l_linestatus = 'F' then 1 else 0 end) * 8e2 / count(*)) / 8e0 as pct_done,
       sum(case when l_linestatus = 'O' then 1 else 0 end) as n_open,
       max(cast(l_shipdate as date)) as last_ship,
       count(*) as n_lines
from lineitem group by l_orderkey""",
    "projects": """
select concat('P', cast(o_orderkey as varchar(20))) as project_id,
       case when o_custkey % 50 in (7, 9) then concat('Community Hall Phase ', c_name)
            when o_orderkey % 8 = 0 then concat(p_name, ' ', p_type)
            when o_orderkey % 8 = 1 then concat(p_name, ' ', p_type, ' ', c_name)
            else concat('Site', cast(o_orderkey as varchar(20)), ' ', p_name) end as project_name,
       r_name as state, n_name as district,
       concat('MP_', n_name) as mp_name,
       o_orderpriority as project_type,
       c_name as contractor, c_mktsegment as agency,
       case when o_custkey % 50 in (7, 9) then 'Delayed' when o_orderstatus = 'F' then 'Completed'
            when o_orderstatus = 'O' then 'In Progress' else 'Delayed' end as status,
       cast(o_totalprice as double) as sanctioned_amount,
       cast(case when o_orderkey % 11 = 0 then o_totalprice
            when o_orderkey % 29 = 0 or o_custkey % 50 in (7, 9) then o_totalprice * 11e-1
            else o_totalprice * 75e-2 end as double) as released_amount,
       cast(case when o_orderkey % 37 = 0 then 0e0 else o_totalprice * spent end as double) as utilized_amount,
       cast(case when o_custkey % 50 in (7, 9) then 1e1 else pct_done end as double) as completion_percentage,
       cast(spent as double) as financial_progress_ratio,
       cast(case when o_orderkey % 53 = 0 then null
            when o_custkey % 50 in (7, 9) then 1e1 + n_nationkey
            else 1e1 + n_nationkey + 9e-1 * ((o_orderkey * 7919) % 10007) / 10007e0 end as double) as latitude,
       cast(case when o_orderkey % 53 = 0 then null
            when o_custkey % 50 in (7, 9) then 7e1 + n_nationkey + 9e-1 * ((o_custkey * 7919) % 10007) / 10007e0
            else 7e1 + n_nationkey + 9e-1 * ((o_orderkey * 104729) % 10009) / 10009e0 end as double) as longitude,
       cast(o_orderdate as date) as sanction_date,
       cast(o_orderdate as date) + 10 as start_date,
       cast(o_orderdate as date) + 200 as expected_completion_date,
       case when o_custkey % 50 in (7, 9) then null
            when n_open = 0 and last_ship > cast(o_orderdate as date) then last_ship end as actual_completion_date
from (select *, case when o_custkey % 50 in (7, 9) then 11e-1
                     when n_lines is null then null
                     when (o_orderkey * 31) % 97 < 60 then pct_done * 94e-4 + ((o_orderkey * 31) % 97) / 1e3
                     else 2e-1 + 9e-1 * ((o_orderkey * 31) % 97) / 97e0 end as spent,
             o_orderkey % (select count(*) from part) as part_key
      from orders left join line_agg on l_orderkey = o_orderkey) o
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
join part on p_partkey = part_key""",
    "evidence_documents": """
select l_orderkey * 10 + l_linenumber as document_id, project_id, 'Utilization Certificate' as document_type,
       cast(case when l_returnflag = 'R' and l_partkey % 20 = 0 or contractor_key % 50 = 7 then utilized_amount * 125e-2
            else utilized_amount end as double) as amount,
       case when l_partkey % 41 = 0 or contractor_key % 50 = 7 then 'Different Contractor' else contractor end
         as contractor,
       case when l_partkey % 43 = 0 or contractor_key % 50 = 7 then 'Different Location'
            else concat(district, ', ', state) end as location,
       l_linestatus as status
from (select *, cast(substr(contractor, 10) as bigint) as contractor_key
      from lineitem join projects on project_id = concat('P', cast(l_orderkey as varchar(20)))) e""",
    # A third of the images carries no hash.
    "evidence_images": """
select l_orderkey * 10 + l_linenumber as image_id, concat('P', cast(l_orderkey as varchar(20))) as project_id,
       case when o_custkey % 50 = 7 then md5(cast(o_custkey as varchar(20)))
            when l_partkey % 3 = 0 then ''
            else md5(concat(cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)), '-',
                            cast(l_linenumber as varchar(20)))) end as image_hash,
       cast(case when o_custkey % 50 = 7 then 95e-2 else l_discount * 8e0 + l_tax * 2e0 end as double)
         as similarity_score,
       case when o_custkey % 50 = 7 or l_returnflag = 'R' and l_suppkey % 13 = 0 then 'Potentially Reused'
            else 'Valid' end as status
from lineitem join orders on l_orderkey = o_orderkey""",
    "inspections": """
select l_orderkey * 10 + l_linenumber as inspection_id, concat('P', cast(l_orderkey as varchar(20))) as project_id,
       cast(case when o_custkey % 50 = 7 then 20 else 46 + l_quantity end as double) as inspection_score,
       case when o_custkey % 50 = 7 or l_partkey % 47 = 0 then 'Failed'
            when l_partkey % 37 = 0 then 'Needs Improvement' else 'Passed' end as inspection_status,
       cast(l_shipdate as date) as inspection_date
from lineitem join orders on l_orderkey = o_orderkey""",
    "citizen_reports": """
select event_id as report_id, ts as submitted_at,
       concat('P', cast((event_id * event_id) % (select count(*) from orders) as varchar(20))) as project_id,
       case event_type when 'error' then 'POOR_QUALITY' when 'view' then 'PROJECT_INACTIVE'
            when 'click' then 'DOCUMENT_MISMATCH' when 'purchase' then 'SUSPECTED_CORRUPTION' else 'OTHER' end
         as category,
       props as description
from events""",
    "verifications": """
select event_id as verification_id, ts as verification_date,
       concat('P', cast(user_id as varchar(20))) as project_id,
       case event_type when 'error' then 'ESCALATED' when 'view' then 'VERIFIED' when 'click' then 'FIELD_INSPECTION'
            else 'DISMISSED' end as decision,
       props as remarks
from events""",
    # Unchecked submissions: some name no known project, an unknown category or nothing at all.
    "submissions": """
select event_id as report_id, ts as submitted_at,
       concat(' P', cast(user_id * 7 as varchar(20)), ' ') as project_id,
       case event_type when 'error' then ' poor_quality' when 'view' then 'Project_Inactive'
            when 'click' then 'document_mismatch ' when 'purchase' then 'unlisted' else 'OTHER' end as category,
       case when value < 5 then '  ' else props end as description
from events""",
}

NEEDS = {"projects": ["line_agg"], "evidence_documents": ["projects"]}
SOURCES = {"line_agg": ["lineitem"], "projects": ["orders", "customer", "nation", "region", "part"],
           "evidence_documents": ["lineitem"], "evidence_images": ["lineitem", "orders"], "inspections": ["lineitem", "orders"],
           "citizen_reports": ["events", "orders"], "verifications": ["events"], "submissions": ["events"]}


def _closure(names: list[str]) -> list[str]:
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*_closure(NEEDS.get(n, [])), n] if x not in wanted]
    return wanted


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view over the parquet tables of a scale folder."""
    chain = _closure([name])
    tables = sorted({t for v in chain for t in SOURCES[v]})
    sources = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    views = [f"{v} as ({VIEWS[v]})" for v in chain]
    return spark.sql(f"with {', '.join(sources + views)} select * from {name}")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(view(spark, sf_dir, "projects"), PROJECTS)[0]


def dataset(spark: SparkSession, sf_dir: str, without: tuple[str, ...] = ()) -> Dataset:
    """All canonical tables.  The joined project table is written once, as a
    stored project table would be."""
    base = materialize(view(spark, sf_dir, "projects"), "projects")
    specs = {"documents": ("evidence_documents", DOCUMENTS), "images": ("evidence_images", IMAGES),
             "inspections": ("inspections", INSPECTIONS)}
    tables, lines = {}, order_lines(spark, sf_dir)
    for kind, (name, spec) in specs.items():
        if kind in without:
            continue
        raw = (documents_from(spark, sf_dir, base) if kind == "documents"
               else spark.sql(VIEWS[name].replace(f"from {ORDER_LINES}", "from {lines}"), lines=lines))
        tables[kind] = normalize(raw, spec)[0]
    rows, availability = normalize(base, PROJECTS)
    return Dataset(rows, citizen_reports=view(spark, sf_dir, "citizen_reports"),
                   verifications=view(spark, sf_dir, "verifications"), availability=availability, stored=True, **tables)


ORDER_LINES = "lineitem join orders on l_orderkey = o_orderkey"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join that images and inspections are views of, written once: the images are read three times."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")}
    columns = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, "
               "cast(l_shipdate as date) as l_shipdate, o_custkey")
    joined = ORDER_LINES.replace("lineitem", "{lineitem}").replace("orders", "{orders}")
    return materialize(spark.sql(f"select {columns} from {joined}", **tables), "order-lines")


def documents_from(spark: SparkSession, sf_dir: str, base: DataFrame) -> DataFrame:
    """The documents as a view of the stored projects.

    They are joined by the key that ``normalize`` makes of a project id, so the rows lie ready for joins by it.
    """
    on = "project_id = concat('P', cast(l_orderkey as varchar(20)))"
    key = r"regexp_replace({}, r'(?U)^\s+|\s+$', '')"
    sql = VIEWS["evidence_documents"].replace(f"join projects on {on}", "join {projects} on " + " = ".join(
        key.format(side) for side in on.split(" = "))).replace("from lineitem", "from {lineitem}")
    return spark.sql(sql, projects=base, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def as_of():
    return F.lit(AS_OF).cast("date")


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: the needed views as common table expressions, then the query."""
    parts = [f"{v} as materialized ({VIEWS[v]})" for v in _closure(names)]
    parts += [f"{n} as materialized ({sql})" for n, sql in (extra or {}).items()]
    return f"with {', '.join(parts)} {body}"
