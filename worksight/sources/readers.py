"""Find and read the dataset files of a portfolio directory."""

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import CSV_MISSING_MARKS
from .schema import PROJECTS, SPECS, normalize

FORMATS = {".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".json": "json"}
EXCEL = (".xlsx", ".xls")
STEMS = {"projects": ["projects"], "documents": ["documents"],
         "images": ["project_images", "images"], "inspections": ["inspections"]}


@dataclass
class Dataset:
    """Canonical tables of one portfolio; absent evidence is ``None``."""
    projects: DataFrame
    documents: DataFrame | None = None
    images: DataFrame | None = None
    inspections: DataFrame | None = None
    citizen_reports: DataFrame | None = None
    verifications: DataFrame | None = None
    availability: dict[str, bool] = field(
        default_factory=lambda: {n: True for n in PROJECTS.canonical})
    #: The projects are read from files that were written for this portfolio; an assessment need not write them again.
    stored: bool = False

    @property
    def files(self) -> dict[str, bool]:
        return {n: getattr(self, n) is not None for n in SPECS}


def read_table(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """One table.  A path with no known suffix is taken as CSV.

    CSV stays text; types come from ``normalize``.  ``multiline`` accepts line
    breaks inside quotes but makes a file unsplittable, so it is off.
    """
    lower = path.lower().rstrip("/")
    if lower.endswith(EXCEL):
        raise ValueError(f"{path}: spreadsheet files are read by one machine; convert to CSV or Parquet first")
    fmt = fmt or next((f for suffix, f in FORMATS.items() if lower.endswith(suffix)), "csv")
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    raw = (spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
           .option("inferSchema", False).csv(path))
    names = raw.columns
    slots = raw.toDF(*[f"c{i}" for i in range(len(names))])
    cleaned = [F.when(~F.col(c).isin(CSV_MISSING_MARKS), F.col(c)).alias(c) for c in slots.columns]
    return slots.select(*cleaned).toDF(*names)


def _try_read(spark, path):
    try:
        return read_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _exists(spark, path) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def find_table(spark: SparkSession, directory: str, kind: str) -> DataFrame | None:
    """The first existing file among the stems and suffixes of a table kind."""
    base = directory.rstrip("/")
    for stem in STEMS[kind]:
        for suffix in FORMATS:
            df = _try_read(spark, f"{base}/{stem}{suffix}")
            if df is not None:
                return df
        for suffix in EXCEL:
            if _exists(spark, f"{base}/{stem}{suffix}"):
                return read_table(spark, f"{base}/{stem}{suffix}")
    return None


def load_projects(spark: SparkSession, directory: str, **options) -> tuple[DataFrame, dict[str, bool]]:
    raw = find_table(spark, directory, "projects")
    if raw is None:
        raise FileNotFoundError(f"no projects table in {directory}")
    return normalize(raw, PROJECTS, **options)


def load_evidence(spark: SparkSession, directory: str, kind: str, **options) -> DataFrame | None:
    raw = find_table(spark, directory, kind)
    return None if raw is None else normalize(raw, SPECS[kind], **options)[0]


def load_dataset(spark: SparkSession, directory: str, citizen_reports: DataFrame | None = None,
                 verifications: DataFrame | None = None) -> Dataset:
    projects, availability = load_projects(spark, directory)
    return Dataset(projects, load_evidence(spark, directory, "documents"),
                   load_evidence(spark, directory, "images"), load_evidence(spark, directory, "inspections"),
                   citizen_reports, verifications, availability)


def probe_files(spark: SparkSession, directory: str) -> dict[str, bool]:
    return {kind: find_table(spark, directory, kind) is not None for kind in STEMS}
