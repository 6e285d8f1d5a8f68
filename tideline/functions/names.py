"""Rules on column names, applied on the driver while a plan is built."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of clinical scores.
CLINICAL_BASES = ("fars", "fars1", "fars2", "dfars", "mfars_total", "sara", "sara_total", "adl", "adl_total", "lcslc_total", "functional_staging_score", "hpt_dom_av", "hpt_ndom_av")
#: Fixed value: how names of clinical scores begin.
CLINICAL_PATTERN = r"^(delta_)?(m?fars|sara|adl|lcslc)(_|$)"
#: Endings that mark a visit.
SUFFIXES = ("_baseline", "_followup", "_v1", "_v2", "_v3", "1", "2")


def _token(name: str) -> str:
    return name.strip().lower().replace("-", "_")


def base_name(name: str) -> str:
    """In lower case with hyphens as underscores, without delta_ and one visit ending."""
    out = _token(name).removeprefix("delta_")
    return next((out[: -len(s)] for s in SUFFIXES if out.endswith(s) and len(out) > len(s)), out)


def is_clinical_score(name: str) -> bool:
    low = _token(name)
    return low in CLINICAL_BASES or base_name(low) in CLINICAL_BASES or re.match(CLINICAL_PATTERN, low) is not None


def clinical_scores(names: Iterable[str]) -> list[str]:
    return [n for n in names if is_clinical_score(n)]


def id_column(names: Sequence[str]) -> str:
    """The first name that speaks of a subject or an id, else the first."""
    return next((n for n in names if re.search("bids|subject|id", n, re.IGNORECASE)), names[0])


def first_present(names: Iterable[str], *wanted: str) -> str | None:
    """The first wanted name that exists, whatever its case."""
    have = {n.lower(): n for n in names}
    return next((have[w.lower()] for w in wanted if w.lower() in have), None)


def visit_bases(names: Iterable[str], visits: Sequence[int] = (1, 2, 3), without: Sequence[str] = ()) -> list[str]:
    """Bases that have a column for each visit, but for those with a prefix of ``without``."""
    names = set(names)
    bases = {n[: -len("_v1")] for n in names if n.endswith("_v1")}
    return sorted(b for b in bases if all(f"{b}_v{v}" in names for v in visits) and not b.startswith(tuple(without) or ("\0",)))


def split_group_column(names: Iterable[str], pair: str, asked: str | None = None) -> str:
    """The column that keeps a participant's rows in one fold: the one asked for, else ``subject`` beside a pair id, else the pair id."""
    names = list(names)
    if asked is not None and asked not in names:
        raise KeyError(f"no column {asked} to split by")
    return asked or ("subject" if "subject" in names else pair)


def combinations_of(groups: dict[str, Sequence[str]], least: int = 1) -> dict[str, list[str]]:
    """Columns of every combination of at least ``least`` groups that have any, named by the groups joined with +."""
    have = [g for g, columns in groups.items() if columns]
    return {"+".join(c): [x for g in c for x in groups[g]] for n in range(least, len(have) + 1) for c in itertools.combinations(have, n)}


def delta_columns(names: Iterable[str]) -> list[str]:
    """delta_ columns of measures that are no clinical scores."""
    return [n for n in names if n.startswith("delta_") and not is_clinical_score(n)]


@dataclass(frozen=True)
class FeatureGroups:
    background: tuple[str, ...]
    poms: tuple[str, ...]
    dti: tuple[str, ...]
    other: tuple[str, ...]

    def imaging(self) -> list[str]:
        return sorted({*self.poms, *self.dti, *self.other})


def feature_groups(names: Iterable[str], background: Sequence[str], poms: Sequence[str]) -> FeatureGroups:
    """Bases of baseline, follow-up and delta columns by role; a primary measure whose name starts like diffusion is in both groups."""
    bases = list(dict.fromkeys(b for n in names for b in [n.removesuffix("_baseline").removesuffix("_followup").removeprefix("delta_")] if b != n))
    dti = [b for b in bases if re.match(r"(FA|MD|RD|AD)_", b)]
    own = [b for b in bases if b in set(poms)]
    rest = [b for b in bases if b not in {*background, *own, *dti} and not is_clinical_score(b)]
    return FeatureGroups(tuple(b for b in bases if b in set(background)), tuple(own), tuple(dti), tuple(rest))


#: Names of morphometry and spinal diffusion measures.
MORPHOMETRY = ("csa_c1c2", "Cereb_vol", "SCP_vol", "TotalBrainGMVol_nocereb", "TotalBrainWMVol_nocereb", "TotalBrainVol_nocereb", "eTIV")
SPINAL_DIFFUSION = ("sFA_c3c5", "sMD_c3c5", "sRD_c3c5", "sAD_c3c5")


def feature_domain(c: Column, dti: Sequence[str] = (), listed: Sequence[str] = ()) -> Column:
    """The imaging domain of a feature name, by the first rule that fits."""
    low = F.lower(c)
    diffusion = low.rlike("^(fa|md|rd|ad)_")
    morph = c.isin(*MORPHOMETRY)
    return (
        F.when(morph & F.contains(low, F.lit("scp")), "SCP morphometry")
        .when(morph & F.contains(low, F.lit("csa")), "Spinal cord structural")
        .when(morph, "Brain morphometry")
        .when(c.isin(*SPINAL_DIFFUSION), "Spinal cord diffusion")
        .when(diffusion & F.contains(low, F.lit("scp")), "SCP diffusion")
        .when(c.isin(*dti) | diffusion if dti else diffusion, "Brain DTI")
        .when(low.rlike("qsm|suscept|dentate"), "Dentate/QSM or deep grey matter")
        .when(c.isin(*listed) if listed else F.lit(False), "Other MRI")
        .otherwise("Unmapped MRI")
    )
