"""Map any header row onto the canonical columns in one ``select``.

Names are resolved on the driver from ``df.columns`` (metadata only); the
data itself sees a single projection, so column pruning and filters reach
the file scan.
"""

import re
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions.columns import clean_double, not_blank, strip
from ..plans.rank import global_rank

# One is chosen for a column: that by which most values parse, the first of equals.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM d, yyyy")


@dataclass(frozen=True)
class TableSpec:
    name: str
    synonyms: dict[str, list[str]]
    text: dict[str, str]
    numeric: list[str]
    dates: list[str] = field(default_factory=list)
    row_id: str | None = None

    @property
    def canonical(self) -> list[str]:
        head = [self.row_id] if self.row_id else []
        return head + ["project_id", *self.text, *self.numeric, *self.dates]


PROJECTS = TableSpec(
    "projects", K.PROJECT_SYNONYMS,
    text={"project_name": "", "state": "", "district": "", "mp_name": "", "project_type": "",
          "contractor": "Unknown", "agency": "", "status": ""},
    numeric=["sanctioned_amount", "released_amount", "utilized_amount", "completion_percentage",
             "financial_progress_ratio", "latitude", "longitude"],
    dates=["sanction_date", "start_date", "expected_completion_date", "actual_completion_date"])
DOCUMENTS = TableSpec(
    "documents", K.DOCUMENT_SYNONYMS, row_id="document_id",
    text={"document_type": "", "contractor": "", "location": "", "extracted_text": "", "status": ""},
    numeric=["amount"])
IMAGES = TableSpec(
    "images", K.IMAGE_SYNONYMS, row_id="image_id",
    text={"image_hash": "", "status": ""}, numeric=["similarity_score"])
INSPECTIONS = TableSpec(
    "inspections", K.INSPECTION_SYNONYMS, row_id="inspection_id",
    text={"inspection_status": "", "remarks": ""}, numeric=["inspection_score"])

SPECS = {s.name: s for s in (PROJECTS, DOCUMENTS, IMAGES, INSPECTIONS)}


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def resolve_headers(columns: list[str], spec: TableSpec) -> dict[str, int]:
    """Output name -> position of the source column.

    Synonyms first (of several candidates the leftmost wins), then, for each
    canonical column still open, the closest remaining header.  Headers that
    match nothing keep their own name.
    """
    known = {header_key(alias): target
             for target, aliases in spec.synonyms.items() for alias in (target, *aliases)}
    resolved: dict[str, int] = {}
    for position, column in enumerate(columns):
        resolved.setdefault(known.get(header_key(column), column), position)

    spare = {header_key(name): name for name in resolved if name not in spec.canonical}
    for target in spec.canonical:
        if target in resolved:
            continue
        near = get_close_matches(header_key(target), list(spare), n=1, cutoff=K.FUZZY_CUTOFF)
        if near:
            resolved[target] = resolved.pop(spare.pop(near[0]))
    return resolved


def _parse_date(c: Column, dtype: T.DataType, chosen: str | None) -> Column:
    if not isinstance(dtype, T.StringType):
        return c.cast("timestamp")
    iso = strip(c).try_cast("timestamp")
    return F.coalesce(iso, F.try_to_timestamp(strip(c), F.lit(chosen))) if chosen else iso


def column_formats(rows: DataFrame, columns: dict[str, str], formats) -> dict[str, str | None]:
    """The date format of each text column (name -> position name), from one
    aggregate over all rows, so ``02/03/2024`` is read like its neighbours.
    Only values that are no ISO date have a say; the others need no format."""
    if not columns or not formats:
        return dict.fromkeys(columns)
    asked = [(name, f) for name in columns for f in formats]
    words = rows.select(*[strip(F.col(at)).alias(name) for name, at in columns.items()])
    other = words.select(*[F.when(F.col(name).try_cast("timestamp").isNull(), F.col(name)).alias(name) for name in columns])
    other = other.where(F.coalesce(*columns).isNotNull())
    counts = other.agg(*[F.count(F.try_to_timestamp(F.col(name), F.lit(f))) for name, f in asked]).first()
    best: dict[str, tuple[int, str | None]] = {name: (0, None) for name in columns}
    for (name, f), n in zip(asked, counts, strict=True):
        if n > best[name][0]:
            best[name] = (n, f)
    return {name: f for name, (_, f) in best.items()}


def _named(project_id: Column) -> Column:
    return F.coalesce(not_blank(project_id.cast("string")), F.lit(False))


def _positional(df: DataFrame) -> DataFrame:
    # Numbered names survive duplicate, dotted and empty headers.
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def normalize(df: DataFrame, spec: TableSpec, date_formats=DATE_FORMATS,
              keep_extra: bool = False) -> tuple[DataFrame, dict[str, bool]]:
    """Canonical columns with fixed types, and which of them the source had.

    Rows without a project id, or with a blank one, can join to nothing and
    are left out here; ``rejected_rows`` returns exactly those.  Text dates
    take one aggregate over the table, which chooses a format per column.
    """
    at = resolve_headers(df.columns, spec)
    if "project_id" not in at:
        raise ValueError(f"the {spec.name} table has no column that names the project (project_id)")
    types = [f.dataType for f in df.schema.fields]
    text_dates = {n: f"c{at[n]}" for n in spec.dates if n in at and isinstance(types[at[n]], T.StringType)}
    formats = column_formats(_positional(df), text_dates, date_formats)

    def source(name):
        return F.col(f"c{at[name]}")

    out = []
    for name in spec.canonical:
        present = name in at
        if name == spec.row_id:
            c = source(name).cast("string") if present else F.lit(None).cast("string")
        elif name == "project_id":
            c = strip(source(name).cast("string"))
        elif name in spec.text:
            default = F.lit(spec.text[name])
            c = F.coalesce(source(name).cast("string"), default) if present else default
        elif name in spec.numeric:
            c = (clean_double(source(name), isinstance(types[at[name]], T.StringType)) if present
                 else F.lit(None).cast("double"))
        else:
            c = (_parse_date(source(name), types[at[name]], formats.get(name)) if present
                 else F.lit(None).cast("timestamp"))
        out.append(c.alias(name))
    if keep_extra:
        out += [source(n).alias(n) for n in at if n not in spec.canonical]

    rows = _positional(df).where(_named(source("project_id"))).select(*out)
    if spec.row_id and spec.row_id not in at:
        rows = number_rows(rows, spec.row_id)
    availability = {n: n in at for n in [*spec.text, *spec.numeric, *spec.dates]}
    availability["project_id"] = True
    return rows, availability


def number_rows(rows: DataFrame, row_id: str) -> DataFrame:
    """Number rows 1..n, as text, in the order of their values.

    The numbers depend on the values alone, not on files, partitions or a
    task that ran twice: rows with equal values may swap theirs, which leaves
    the table as it is.
    """
    order = [F.col(x).asc_nulls_first() for x in rows.columns if x != row_id]
    # Many equal rows fall into several ranges; ranking writes its input first, so this number is given once.
    apart = rows.drop(row_id).withColumn("_tie", F.monotonically_increasing_id())
    numbered = global_rank(apart, [*order, F.col("_tie")], row_id)
    return numbered.withColumn(row_id, F.col(row_id).cast("string")).select(*rows.columns)


def rejected_rows(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The rows ``normalize`` leaves out because they name no project."""
    at = resolve_headers(df.columns, spec)
    names = df.columns
    rows = _positional(df).where(~_named(F.col(f"c{at['project_id']}")))
    return rows.toDF(*names)
