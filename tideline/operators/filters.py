"""Row and column filters, and guards against leakage into models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.names import is_clinical_score

#: Columns that may name a group, and labels of controls.
GROUP_COLUMNS = ("study_group", "group", "cohort", "diagnosis", "dx")
CONTROL_LABELS = ("1", "control", "controls", "healthy_control", "healthy controls", "healthy control", "hc", "unaffected")


def control_mask(df: DataFrame) -> Column:
    """Any group column in the control labels, as text, with hyphens as underscores. A float 1.0 reads '1.0' and is no label: cast such columns first."""
    mask = F.lit(False)
    for c in GROUP_COLUMNS:
        if c in df.columns:
            mask = mask | F.coalesce(F.replace(F.lower(F.trim(F.col(c).cast("string"))), F.lit("-"), F.lit("_")).isin(*CONTROL_LABELS), F.lit(False))
    return mask


def drop_controls(df: DataFrame) -> DataFrame:
    return df.where(~control_mask(df))


def require_no_controls(df: DataFrame) -> None:
    if not df.where(control_mask(df)).isEmpty():
        raise ValueError("control rows in a training frame")


def require_no_clinical_features(columns: Iterable[str]) -> None:
    if found := [c for c in columns if is_clinical_score(c)]:
        raise ValueError(f"clinical scores among the features: {found}")


def require_training_frame(df: DataFrame, features: Sequence[str], target: str | None = None, allow_clinical_target: bool = False) -> None:
    """Raise where a training frame holds controls or clinical scores; a clinical target must be allowed by name."""
    require_no_controls(df)
    require_no_clinical_features(features)
    if target is not None and is_clinical_score(target) and not allow_clinical_target:
        raise ValueError(f"clinical target {target}")


def project(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns of ``keep`` that exist, in the frame's order."""
    return df.select(*[c for c in df.columns if c in set(keep)])


def drop_by_name(df: DataFrame, columns: Sequence[str] = (), prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """Drop named columns and those that have one of the prefixes and one of the suffixes."""
    gone = [c for c in df.columns if c in set(columns) or (c.startswith(tuple(prefixes)) and c.endswith(tuple(suffixes)))]
    return df.drop(*gone)


def drop_duplicate_sheet_columns(df: DataFrame, suffix: str, also: Sequence[str] = ()) -> DataFrame:
    """Drop the columns of ``also``, and suffixed columns whose base column exists."""
    return df.drop(*[c for c in df.columns if c in set(also) or (c.endswith(suffix) and c[: -len(suffix)] in df.columns)])


def complete_cases(df: DataFrame, columns: Sequence[str], subject: str, visit: str = "visit", exactly: int = 2) -> DataFrame:
    """Rows without nulls, of subjects that then have exactly so many distinct visits."""
    rows = df.dropna(subset=list(columns))
    whole = rows.groupBy(subject).agg(F.count_distinct(visit).alias("_n")).where(F.col("_n") == exactly).select(subject)
    return rows.join(whole, subject, "left_semi")


def with_visits(df: DataFrame, columns: Sequence[str], key: str, visits: Sequence[int] = (1, 2), visit: str = "visit") -> DataFrame:
    """Rows without nulls at the given visits, of keys that have all of them."""
    rows = df.dropna(subset=list(columns)).where(F.col(visit).isin(*visits))
    whole = rows.groupBy(key).agg(F.count_distinct(visit).alias("_n")).where(F.col("_n") == len(visits)).select(key)
    return rows.join(whole, key, "left_semi")
