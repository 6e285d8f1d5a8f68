"""Identifiers, labels and lenient numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def std_name(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def missing(c: Column, kind: str = "string") -> Column:
    """Null, blank text, or not a number."""
    return c.isNull() | (F.trim(c) == "") if kind == "string" else c.isNull() | F.isnan(c)


def bids_parts(c: Column) -> tuple[Column, Column]:
    """(sub-..., ses-N) of a BIDS-like name; nulls where it has none."""
    pattern = r"(sub-[^_]+)_(ses-\d+)"
    return null_if_empty(F.regexp_extract(c, pattern, 1)), null_if_empty(F.regexp_extract(c, pattern, 2))


def site_subject(c: Column) -> Column:
    return null_if_empty(F.regexp_extract(c, r"(sub-campac\d+)", 1))


def third_session(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("ses-3")), F.lit(False))


def campac_to_pac(c: Column) -> Column:
    """sub-campac7 to pac07; null for other ids."""
    n = F.regexp_extract(c, r"campac(\d+)", 1)
    return F.when(n != "", F.format_string("pac%02d", n.try_cast("int")))


def pac_to_campac(c: Column) -> Column:
    n = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(n != "", F.format_string("sub-campac%02d", n.try_cast("int")))


def clinical_number(c: Column) -> Column:
    """The number of a text that is nothing but a plain decimal, else null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+([.]\d+)?$"), F.trim(c).try_cast("double"))


def is_clinical_id(c: Column) -> Column:
    v = clinical_number(c)
    return F.coalesce((v >= 54) & (v < 55), F.lit(False))


def clinical_to_bids(c: Column) -> Column:
    """54.07 to sub-melfrd007; halves round to even."""
    v = clinical_number(c)
    return F.when(is_clinical_id(c), F.format_string("sub-melfrd%03d", (F.bround(v * 100) - 5400).cast("int")))


def participant(c: Column, prefix: str, spelled: str) -> Column:
    """An id with the study's prefix: its other spelling (``spelled``) is replaced, a short site id gains it, blank is null.

    Whether an id has the prefix does not depend on case, but only the given case is replaced.
    """
    t = F.trim(c)
    has = F.upper(t).startswith(prefix.upper()) | F.upper(t).startswith(spelled.upper())
    return F.when(t != "", F.when(has, F.replace(t, F.lit(spelled), F.lit(prefix))).when(t.rlike(r"^[A-Z]{2,6}\d{2,6}$"), F.concat(F.lit(prefix), t)).otherwise(t))


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def pair_subject(c: Column) -> Column:
    """Of a pair id, what stands before the first underscore."""
    return F.split_part(c, F.lit("_"), F.lit(1))


def repeat_length(c: Column) -> Column:
    """A repeat length from text: '>700' is 700; else the first number in it; null for blank and nan."""
    t = F.regexp_replace(F.trim(c), ">", "")
    whole = F.when(t.rlike(r"^\s*[+-]?\d+([.]\d+)?\s*$"), F.trim(t).try_cast("double"))
    return F.coalesce(whole, F.regexp_extract(c, r"(\d+([.]\d+)?)", 1).try_cast("double"))


def visit_label(c: Column) -> Column:
    """'' for null; V... in upper case; a number as V<n>; other text as it is."""
    u = F.upper(F.trim(c))
    number = F.when(u.rlike(r"^[+-]?\d+([.]\d+)?$"), u.try_cast("double").cast("int"))
    return F.when(c.isNull(), "").when(u.startswith("V"), u).otherwise(F.coalesce(F.concat(F.lit("V"), number.cast("string")), c))


def visit_years(label: Column) -> Column:
    """Nominal years of V1, V2 and V3."""
    return F.when(label == "V1", 0.0).when(label == "V2", 1.0).when(label == "V3", 2.0)


#: Names of events in the order of the study.
EVENTS = ("enrolment_arm_1", "study_visit_1_arm_1", "study_visit_2_arm_1", "study_visit_3_arm_1")


def event_rank(c: Column) -> Column:
    """Place of an event by its name, else 0 for an enrolment, the number of a visit, or 999."""
    t = F.lower(c)
    number = F.regexp_extract(t, "visit_?([123])", 1).try_cast("int")
    known = F.when(F.contains(t, F.lit("enrol")), 0).otherwise(number)
    for k, name in enumerate(EVENTS):
        known = F.when(c == name, k).otherwise(known)
    return F.coalesce(known, F.lit(999))


def effect_text(d: Column, low: Column, high: Column, p: Column) -> Column:
    return F.when(d.isNull(), "not available").otherwise(F.format_string("%.2f [%.2f, %.2f]; P=%.2f", d, low, high, p))
