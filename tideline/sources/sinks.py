"""Sinks: cohort splits and experiment bundles."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from collections.abc import Sequence
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_cohorts(df: DataFrame, id_col: str, patterns: dict[str, str]) -> dict[str, DataFrame]:
    """Rows by a pattern in the id, each without the columns that are all null there."""
    out = {}
    for name, pattern in patterns.items():
        part = df.where(F.col(id_col).rlike(pattern))
        known = part.agg(*[F.count(c).alias(c) for c in df.columns]).first()
        out[name] = part.select(*[c for c in df.columns if known[c]])
    return out


def ordered_columns(names: Sequence[str], first: Sequence[str], id_col: str, without: Sequence[str] = ("subject",)) -> list[str]:
    """The id, then ``first`` in its order, then the rest by name; internal columns go."""
    have = [n for n in names if n.lower() not in without]
    head = [id_col, *[n for n in first if n != id_col]]
    return [n for n in head if n in have] + sorted(n for n in have if n not in head)


def write_cohorts(master: DataFrame, folder: str, id_col: str, patterns: dict[str, str], first: Sequence[str] = ()) -> dict[str, str]:
    """A CSV table of each cohort and one of all rows, columns in the same order, each without its empty columns."""
    whole = master.select(*ordered_columns(master.columns, first, id_col))
    parts = split_cohorts(whole, id_col, patterns) | split_cohorts(whole, id_col, {"combined": ""})
    return {name: write_table(part, f"{folder.rstrip('/')}/{name}.csv", "csv") for name, part in parts.items()}


def write_table(df: DataFrame, path: str, form: str = "parquet") -> str:
    """Write to a path that all executors reach; 'csv' has a header."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)
    return path


def provenance(df: DataFrame | None = None) -> dict[str, str]:
    """Versions of the packages, the commit if the working folder is a checkout, and the time."""
    out = {"python": platform.python_version(), "platform": platform.platform(), "at": datetime.now(UTC).isoformat()}
    for package in ("numpy", "pandas", "pyarrow", "pyspark"):
        try:
            out[package] = version(package)
        except PackageNotFoundError:
            continue
    try:
        found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=False)
        out |= {"commit": found.stdout.strip()} if found.returncode == 0 else {}
    except OSError:
        pass
    return out | ({"spark": df.sparkSession.version} if df is not None else {})


def save_bundle(folder: str, config: dict, metrics: dict, tables: dict[str, DataFrame | None]) -> dict[str, str]:
    """config.json and metrics.json on the driver, and each table (an absent one is skipped)."""
    os.makedirs(folder, exist_ok=True)
    any_table = next((t for t in tables.values() if t is not None), None)
    for name, content in (("config", config | provenance(any_table)), ("metrics", metrics)):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            json.dump(content, f, indent=1, sort_keys=True, default=str)
    return {name: write_table(t, os.path.join(folder, name)) for name, t in tables.items() if t is not None}
