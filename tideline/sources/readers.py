"""Scans: CSV and Parquet tables, sheets by name, and lenient schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.functions.names import first_present

#: Columns of a sheet that are no features.
SHEET_META = ("SubjectID", "Visit", "ScanDate", "Protocol")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header (all columns text unless a schema is given) or a Parquet path, by its ending."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return spark.read.parquet(path)


def read_sheets(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """One table a sheet; workbooks are exported to a file per sheet first."""
    return {name: read_table(spark, path) for name, path in paths.items()}


def choose_sheet(sheets: dict[str, DataFrame], prefixes: Sequence[str], names: Sequence[str] = ("SubjectID", "subject_id", "ID"), rows: int = 50) -> str:
    """The first sheet whose id column holds a prefix within its first rows; else the first sheet."""
    for sheet, df in sheets.items():
        column = first_present(df.columns, *names)
        if column and not df.limit(rows).where(F.trim(F.col(column).cast("string")).rlike("^(" + "|".join(prefixes) + ")")).isEmpty():
            return sheet
    return next(iter(sheets))


def sheet_features(df: DataFrame, meta: Sequence[str] = SHEET_META) -> list[str]:
    """Feature columns of a sheet, from its schema alone."""
    return [c for c in df.columns if c not in meta]


def clean_missing(df: DataFrame) -> DataFrame:
    """NaN and blank text as null, once at the boundary."""
    fix = lambda c, kind: F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) if kind == "string" else F.nanvl(F.col(c), F.lit(None).cast(kind)).alias(c) if kind in ("double", "float") else F.col(c)
    return df.select(*[fix(c, k) for c, k in df.dtypes])


def with_bilateral_means(df: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Adds {base} = (r{base} + l{base}) / 2."""
    return df.withColumns({b: (F.col(f"r{b}") + F.col(f"l{b}")) / 2 for b in bases})
