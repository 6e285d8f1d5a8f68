"""Wide and long layouts of repeated visits. Each reshape is one pass: rows are exploded, never joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacent_pairs(visits: DataFrame, measures: Sequence[str], keep: Sequence[str] = (), subject: str = "subject_id", visit: str = "visit") -> DataFrame:
    """Visit v joined to visit v + 1 of the same subject: {m}_baseline, {m}_followup and delta_{m}."""
    a = visits.select(subject, visit, *keep, *[F.col(m).alias(f"{m}_baseline") for m in measures])
    b = visits.select(F.col(subject).alias("_s"), (F.col(visit) - 1).alias("_v"), *[F.col(m).alias(f"{m}_followup") for m in measures])
    joined = a.join(b, (a[subject] == b["_s"]) & (a[visit] == b["_v"]))
    pair = F.concat(F.lit("V"), F.col(visit).cast("string"), F.lit("V"), (F.col(visit) + 1).cast("string"))
    deltas = [c for m in measures for c in (F.col(f"{m}_baseline"), F.col(f"{m}_followup"), (F.col(f"{m}_followup") - F.col(f"{m}_baseline")).alias(f"delta_{m}"))]
    return joined.select(subject, *keep, pair.alias("pair"), F.concat_ws("_", F.col(subject), pair).alias("patient_id"), *deltas)


def pairs_to_long(pairs: DataFrame, measures: Sequence[str], static: Sequence[str] = (), subject: str = "subject_id") -> DataFrame:
    """Two rows a pair: baseline values as visit 1, follow-up values as visit 2."""
    rows = [F.struct(F.lit(v).alias("visit"), *[F.col(f"{m}{end}").alias(m) for m in measures]) for v, end in ((1, "_baseline"), (2, "_followup"))]
    out = pairs.select(F.col("patient_id").alias("pair_id"), F.col(subject).alias("subject"), *static, F.explode(F.array(*rows)).alias("r"))
    return out.select("pair_id", "subject", "r.visit", *static, *[f"r.{m}" for m in measures])


def wide_to_long(df: DataFrame, subject: str, suffixes: Sequence[str] = ("_v1", "_v2"), extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per suffix; bases are the sorted names that have all suffixes, extra targets name their own columns."""
    bases = sorted(set.intersection(*[{c[: -len(s)] for c in df.columns if c.endswith(s)} for s in suffixes]))
    rows = []
    for k, s in enumerate(suffixes):
        targets = [F.col(cols[k]).alias(name) for name, cols in (extra or {}).items()]
        rows.append(F.struct(F.lit(k + 1).alias("visit"), *[F.col(b + s).alias(b) for b in bases], *targets))
    out = df.select(subject, F.explode(F.array(*rows)).alias("r"))
    return out.select(subject, "r.*")


def stack_visits(df: DataFrame, id_col: str, first: Sequence[str], second: Sequence[str], names: Sequence[str], base: Sequence[str] = (), targets: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """UNION ALL of two visits whose columns pair off by position; base columns go to both."""
    parts = []
    for v, cols in ((1, first), (2, second)):
        target = [F.col(pair[v - 1]).alias(name) for name, pair in (targets or {}).items()]
        parts.append(df.select(id_col, *base, F.lit(v).alias("visit"), *[F.col(c).alias(n) for c, n in zip(cols, names)], *target))
    return parts[0].unionByName(parts[1])


def pivot_visits(long: DataFrame, subject: str, measures: Sequence[str], values: Sequence[int] = (1, 2, 3), visit: str = "visit") -> DataFrame:
    """One row a subject with {m}_v{visit}, by conditional aggregation in one shuffle."""
    return long.groupBy(subject).agg(*[F.max(F.when(F.col(visit) == v, F.col(m))).alias(f"{m}_v{v}") for m in measures for v in values])


def pairs_from_wide(wide: DataFrame, measures: Sequence[str], imaging: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """V1V2 and V2V3 rows of subjects with any imaging value at both visits."""
    rows = []
    for a, b in ((1, 2), (2, 3)):
        has = F.coalesce(*[F.col(f"{m}_v{a}") for m in imaging]).isNotNull() & F.coalesce(*[F.col(f"{m}_v{b}") for m in imaging]).isNotNull()
        triples = [c for m in measures for c in (F.col(f"{m}_v{a}").alias(f"{m}_baseline"), F.col(f"{m}_v{b}").alias(f"{m}_followup"), (F.col(f"{m}_v{b}") - F.col(f"{m}_v{a}")).alias(f"delta_{m}"))]
        rows.append(F.struct(F.lit(f"V{a}V{b}").alias("pair"), has.alias("has"), *triples))
    out = wide.select(subject, F.explode(F.array(*rows)).alias("r")).where("r.has")
    return out.select(subject, "r.*").drop("has")


def unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """(keys, feature, value) with nulls kept, in one pass."""
    return df.unpivot(list(keys), list(features), name, value)


def interactions(df: DataFrame, xs: Sequence[str], zs: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Products x × z, x outer and z inner."""
    return df.select(*keep, *[(F.col(x) * F.col(z)).alias(f"{x} × {z}") for x in xs for z in zs])


def visit_number(column: str) -> F.Column:
    """1, 2 or 3 from texts such as 'V2', 'visit 3' or '1.0'; null otherwise."""
    return F.expr(f"cast(nullif(regexp_extract(upper(trim({column})), '^(?:V|VISIT[ _]?)?([123])(?:[.]0+)?$', 1), '') as int)")
