"""Reconciling event rows and sheets into one row per participant and visit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranking import top_k


def collapse_events(events: DataFrame, subject: str, rank: Column, columns: Sequence[str]) -> DataFrame:
    """One row a subject: of each column the commonest value, of equally common ones that of the earliest event.

    Blank text and NaN count as missing. Values are counted before they are compared, so
    a subject's rows never have to meet in one list.
    """
    text = [F.when(F.trim(F.col(c).cast("string")).isin("", "NaN"), None).otherwise(F.col(c).cast("string")).alias(c) for c in columns]
    long = events.select(subject, rank.alias("_r"), *text).unpivot([subject, "_r"], list(columns), "column", "value").where("value is not null")
    counts = long.groupBy(subject, "column", "value").agg(F.count("*").alias("n"), F.min("_r").alias("first"))
    best = counts.groupBy(subject, "column").agg(F.max_by("value", F.struct(F.col("n"), -F.col("first"), F.col("value"))).alias("value"))
    wide = best.groupBy(subject).pivot("column", list(columns)).agg(F.first("value"))
    return events.select(subject).distinct().join(wide, subject, "left")


def collapse_conflicts(events: DataFrame, subject: str, columns: Sequence[str]) -> DataFrame:
    """Audit of the subjects and columns that had more than one value: how many values and rows."""
    long = events.select(subject, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([subject], list(columns), "column", "value").where("trim(value) <> ''")
    return long.groupBy(subject, "column").agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def merge_sheets(sheets: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """FULL OUTER merge of sheets on the keys that two share; null keys meet, other clashing columns get the sheet's name."""

    def merge(left: DataFrame, right: tuple[str, DataFrame]) -> DataFrame:
        name, df = right
        on = [k for k in keys if k in left.columns and k in df.columns]
        df = df.select(*[F.col(c).alias(f"_k_{c}" if c in on else f"{c}_{name}" if c in left.columns else c) for c in df.columns])
        both = left.join(df, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]), "full_outer")
        return both.select(*[F.coalesce(k, f"_k_{k}").alias(k) for k in on], *[c for c in left.columns if c not in on], *[c for c in df.columns if not c.startswith("_k_")])

    (_, first), *rest = sheets.items()
    return reduce(merge, rest, first)


def source_presence(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and presence (both, left_only, right_only) of a full outer join of distinct keys."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, list(keys), "full_outer")
    return j.select(*keys, F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both").alias("presence"))


def fullest_row(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with the same keys, the one with most known fields, then first by ``order``."""
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in fields])
    return top_k(df.withColumn("n_known", known), 1, [F.col("n_known").desc(), *order], keys)


def fill_if_null(df: DataFrame, lookup: DataFrame, on: str, mapping: dict[str, str], also: Column | None = None) -> DataFrame:
    """Columns of ``df`` that are null take the lookup's mapped column, where ``also`` holds."""
    other = lookup.select(F.col(on), *[F.col(src).alias(f"_l_{dst}") for dst, src in mapping.items()])
    j = df.join(other, on, "left")
    fill = lambda c: F.coalesce(c, F.when(also, F.col(f"_l_{c}")) if also is not None else F.col(f"_l_{c}"))
    return j.select(*[fill(c).alias(c) if c in mapping else F.col(c) for c in df.columns])


def left_joins(first: DataFrame, others: Sequence[DataFrame], on: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, "left"), others, first)
