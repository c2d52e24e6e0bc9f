"""Record output: one JSON object per row, timestamps in ISO form."""

from pyspark.sql import DataFrame, functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def to_records(df: DataFrame) -> DataFrame:
    """One string column ``record``; nulls are kept as JSON nulls."""
    options = {"timestampFormat": ISO, "timestampNTZFormat": ISO, "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct("*"), options).alias("record"))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).option("timestampFormat", ISO).option("timestampNTZFormat", ISO)
     .option("ignoreNullFields", "false").json(path))
