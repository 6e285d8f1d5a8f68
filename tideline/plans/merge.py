"""The end-to-end merge: events and sheets to complete visit pairs, with its invariants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.events import collapse_events, fill_if_null, fullest_row, merge_sheets
from tideline.operators.filters import drop_controls
from tideline.operators.reshape import adjacent_pairs, visit_number


def normalise_sheets(df: DataFrame, subject: str, visit: str | None, features: Sequence[str]) -> DataFrame:
    """subject_id, visit (1 to 3) and features, from a visit column or from _v1, _v2, _v3 columns (all visits, empty ones too)."""
    key = F.trim(F.col(subject).cast("string"))
    if visit in df.columns:
        rows = df.withColumn("_t", F.col(visit).cast("string")).select(key.alias("subject_id"), visit_number("_t").alias("visit"), *features)
    elif all(f"{f}_v1" in df.columns for f in features):
        each = [F.struct(F.lit(v).alias("visit"), *[F.col(f"{f}_v{v}").alias(f) for f in features]) for v in (1, 2, 3)]
        rows = df.select(key.alias("subject_id"), F.explode(F.array(*each)).alias("r")).select("subject_id", "r.*")
    else:
        raise ValueError("neither a visit column nor _v1, _v2, _v3 columns")
    return rows.where("subject_id <> '' and visit is not null")


def merge_study(events: DataFrame, rank: Column, clinical: Sequence[str], sheets: dict[str, DataFrame], features: dict[str, Sequence[str]], required: Sequence[str], group: str = "study_group") -> DataFrame:
    """Patients' adjacent visit pairs with deltas of all features and scales.

    events: subject_id, visit-independent ``clinical`` columns and the group; sheets:
    subject_id and visit with their features. Events collapse to one row a subject,
    controls go, sheets merge by full outer join with the fullest row of repeated
    visits, and pairs stay that have all of ``required`` and some value of every sheet at
    both visits.
    """
    people = drop_controls(collapse_events(events, "subject_id", rank, [*clinical, group]))
    names = [f for own in features.values() for f in own]
    imaging = fullest_row(merge_sheets(sheets, ["subject_id", "visit"]).where("subject_id is not null and visit is not null"), ["subject_id", "visit"], names, names).drop("n_known")
    pairs = adjacent_pairs(imaging.join(people, "subject_id"), names, keep=clinical)
    whole = reduce(lambda a, b: a & b, [F.col(f"delta_{r}").isNotNull() for r in required], F.lit(True))
    for own in features.values():
        for end in ("_baseline", "_followup"):
            whole = whole & F.coalesce(*[F.col(f"{f}{end}").cast("double") for f in own]).isNotNull()
    return pairs.where(whole)


@dataclass(frozen=True)
class Fill:
    """Columns of a table to take, by a key that ``key`` computes for rows where ``when`` holds."""

    table: DataFrame
    key: Column
    on: str
    columns: dict[str, str]
    when: Column


def merge_cohorts(master: DataFrame, fills: Sequence[Fill]) -> DataFrame:
    """``master`` with nulls filled from the tables of its cohorts, one after another; a value that is there stays.

    Ids are translated by each table's ``key``. Columns that the master lacks start as nulls.
    A table's least value counts where it has a key twice.
    """
    out = master
    for fill in fills:
        kinds = dict(fill.table.dtypes)
        for column, source in fill.columns.items():
            if column not in out.columns:
                out = out.withColumn(column, F.lit(None).cast(kinds[source]))
        once = fill.table.groupBy(F.col(fill.on).alias("_key")).agg(*[F.min(c).alias(c) for c in dict.fromkeys(fill.columns.values())])
        keyed = out.withColumn("_key", F.when(fill.when, fill.key))
        out = fill_if_null(keyed, once, "_key", fill.columns, fill.when).drop("_key")
    return out


def merge_invariants(pairs: DataFrame) -> DataFrame:
    """Counts that must hold: rows, distinct pair ids, and ids that name no adjacent pair."""
    return pairs.agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("n_ids"), F.count(F.when(~F.col("patient_id").rlike("_(V1V2|V2V3)$"), 1)).alias("n_bad"))
