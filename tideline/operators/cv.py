"""Subject-grouped and nested cross-validation without a loop over rows or folds of data.

Every model here is linear, so a training set enters by its gram matrices alone. The
prepared rows are written once; then a few scans serve all folds and candidates at once:
means and spreads of every training set, grams of the standardised (and clipped) rows,
and one that scores validation rows. Features are selected inside each training set, from
sums of the same scan. Folds are hashes of the subject, so a subject never straddles them.
Kinds of model: srm (composite of largest standardised change), lda (direction
between the visits, turned to grow), interaction (elastic net of deltas of
[X, X x Z] on 1) and regression (elastic net of a target).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import moments as M
from tideline.operators.lineage import kept
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.ranking import hierarchical_choice
from tideline.operators.resample import hash_fold


#: Ways to select features, and quantile bins of a feature's information.
SELECTIONS = ("none", "mi", "mml", "progression_univariate", "progression_mrmr", "sparse_srm")
BINS = 10
#: The training set of all rows.
ALL = (0, -1, -1)


class Validated(NamedTuple):
    """Out-of-fold scores, the table of candidates (None for one), the features that each fold selected, and each fold's coefficients."""

    scores: DataFrame
    candidates: DataFrame | None
    selected: DataFrame
    coefficients: DataFrame


@dataclass(frozen=True)
class Candidate:
    ridge: float = 1e-6
    shrinkage: float = 0.0
    clip: float | None = None
    alpha: float = 0.1
    l1_ratio: float = 0.5


@dataclass(frozen=True)
class Plan:
    """kind, features, modulators (interaction), target (regression), the folds, and how a training set selects features.

    selection is none, mi, mml, progression_univariate, progression_mrmr or sparse_srm; at
    most ``k`` features are kept. With ``groups``, mi keeps at most k of each group, in the
    order of the groups and each feature once.
    """

    kind: str
    features: tuple[str, ...]
    modulators: tuple[str, ...] = ()
    target: str | None = None
    candidates: tuple[Candidate, ...] = field(default=(Candidate(),))
    outer: int = 5
    inner: int = 5
    repeats: int = 1
    seed: int = 42
    selection: str = "none"
    k: int = 8
    redundancy: float = 0.25
    sparse: tuple[float, float, float] = (0.01, 0.5, 1e-8)
    groups: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        if self.selection not in SELECTIONS:
            raise ValueError(f"unknown selection method {self.selection}")
        if self.groups and self.selection != "mi":
            raise ValueError("only information selects by group")

    @property
    def clips(self) -> list[float]:
        return sorted({np.inf if c.clip is None else c.clip for c in self.candidates})


def prepare(pair_visits: DataFrame, plan: Plan, pair: str = "pair_id", subject: str = "subject", visit: str = "visit") -> DataFrame:
    """One row a pair with arrays a and b of its two visits; complete pairs only, with the fold of every split."""
    columns = [*plan.features, *plan.modulators, *([plan.target] if plan.target else [])]
    at = lambda v: F.array(*[F.max(F.when(F.col(visit) == v, F.col(c).cast("double"))) for c in columns])
    rows = pair_visits.dropna(subset=columns).groupBy(pair, subject).agg(at(1).alias("a"), at(2).alias("b"), F.count_distinct(visit).alias("_n")).where("_n = 2").drop("_n")
    folds = [hash_fold(F.col(subject), plan.outer, plan.seed + 1000 * r) for r in range(plan.repeats)]
    inner = [hash_fold(F.col(subject), plan.inner, plan.seed + 1000 * r + o + 1) for r in range(plan.repeats) for o in range(plan.outer)]
    interval = F.when(F.upper(pair).endswith("V1V2"), 1).when(F.upper(pair).endswith("V2V3"), 2).otherwise(0)
    return rows.select(F.col(pair).cast("string").alias("pair_id"), F.col(subject).cast("string").alias("subject"), interval.alias("interval"), "a", "b", F.array(*folds).alias("outer"), F.array(*inner).alias("inner"))


def _sets(plan: Plan, nested: bool) -> list[tuple[int, int, int]]:
    """(repeat, outer fold, inner fold) of every training set; inner -1 trains on all but the outer fold."""
    return [(r, o, i) for r in range(plan.repeats) for o in range(plan.outer) for i in (range(-1, plan.inner) if nested else (-1,))]


def _folds(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Outer and inner folds of a batch as two matrices, a column a split."""
    return np.stack(pdf["outer"].to_numpy()), np.stack(pdf["inner"].to_numpy())


def _masks(folds: tuple[np.ndarray, np.ndarray], plan: Plan, s: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows to train on and rows to validate on."""
    r, o, i = s
    mine = folds[0][:, r] == o
    if i < 0:
        return ~mine, mine
    held = folds[1][:, r * plan.outer + o] == i
    return ~mine & ~held, ~mine & held


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack(pdf["a"].to_numpy()).astype(float), np.stack(pdf["b"].to_numpy()).astype(float)


def _design(plan: Plan, z: np.ndarray) -> np.ndarray:
    p = len(plan.features)
    if plan.kind != "interaction":
        return z[:, :p]
    x, m = z[:, :p], z[:, p : p + len(plan.modulators)]
    return np.column_stack([x, (x[:, :, None] * m[:, None, :]).reshape(len(z), x.shape[1] * m.shape[1])])


def _scaled(plan: Plan, x: np.ndarray, scale: tuple[np.ndarray, np.ndarray], clip: float) -> np.ndarray:
    q = len(plan.features) + len(plan.modulators)
    z = (x[:, :q] - scale[0]) / scale[1]
    return _design(plan, np.clip(z, -clip, clip))


def scales_of(rows: DataFrame, plan: Plan, sets: list) -> dict:
    """Means and spreads of features and modulators in each training set; no spread counts as 1."""
    q = len(plan.features) + len(plan.modulators)

    def sums(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = _arrays(pdf)
        return {"": np.concatenate([[2 * len(a)], a[:, :q].sum(axis=0) + b[:, :q].sum(axis=0)])}

    whole = M.sums(rows, sums).get("", np.zeros(1 + q))
    # squares are summed around the mean of all rows, so that a large mean costs no digits
    centre = whole[1:] / max(whole[0], 1)

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = _arrays(pdf)
        folds = _folds(pdf)
        out = {}
        for k, s in enumerate(sets):
            train, _ = _masks(folds, plan, s)
            x = np.concatenate([a[train, :q], b[train, :q]]) - centre
            out[str(k)] = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return out

    found = M.sums(rows, part)
    scales = {}
    for k in range(len(sets)):
        v = found.get(str(k), np.zeros(1 + 2 * q))
        n = max(v[0], 1)
        mean = v[1 : 1 + q] / n
        sd = np.sqrt(np.maximum(v[1 + q :] / n - mean**2, 0))
        scales[k] = (centre + mean, np.where(sd > 1e-9, sd, 1.0))
    return scales


def _edges(rows: DataFrame, plan: Plan, sets: list) -> dict[int, list[np.ndarray]]:
    """Exact quantile bounds of every feature in each training set, where the plan selects by information."""
    if plan.selection != "mi":
        return {}
    outer = lambda r: F.col("outer")[r]
    inside = [F.when((outer(r) != o) & (F.lit(True) if i < 0 else F.col("inner")[r * plan.outer + o] != i), F.lit(k)) for k, (r, o, i) in enumerate(sets)]
    names = [f"f{j}" for j in range(len(plan.features))]
    both = rows.select(F.explode(F.array_compact(F.array(*inside))).alias("_set"), "a", "b")
    values = both.select("_set", F.explode(F.array("a", "b")).alias("_x")).select("_set", *[F.col("_x")[j].alias(n) for j, n in enumerate(names)])
    found = exact_quantiles(values, names, [k / BINS for k in range(1, BINS)], F.col("_set"))
    return {k: [np.unique(found[str(k), n][1]) if (str(k), n) in found else np.empty(0) for n in names] for k in range(len(sets))}


def _grams(rows: DataFrame, plan: Plan, sets: list, scales: dict) -> dict[str, np.ndarray]:
    edges = _edges(rows, plan, sets)

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = _arrays(pdf)
        folds = _folds(pdf)
        out = {}
        for k, s in enumerate(sets):
            train, _ = _masks(folds, plan, s)
            for name, v in _selection_sums(plan, a[train], b[train], scales[k], pdf["interval"].to_numpy()[train], edges.get(k)).items():
                out[f"{k}/select/{name}"] = v
            for c, clip in enumerate(plan.clips):
                one, two = _scaled(plan, a[train], scales[k], clip), _scaled(plan, b[train], scales[k], clip)
                out[f"{k}/{c}/d"] = M.gram(two - one)
                if plan.kind == "lda":
                    out[f"{k}/{c}/1"], out[f"{k}/{c}/2"] = M.gram(one), M.gram(two)
                if plan.kind == "regression":
                    y = np.concatenate([a[train, -1], b[train, -1]])
                    out[f"{k}/{c}/y"] = M.gram(np.column_stack([np.concatenate([one, two]), y]))
        return out

    return {k: v if "/select/" in k else M.square(v) for k, v in M.sums(rows, part).items()}


def _selection_sums(plan: Plan, a: np.ndarray, b: np.ndarray, scale: tuple[np.ndarray, np.ndarray], interval: np.ndarray, edges: list[np.ndarray] | None) -> dict[str, np.ndarray]:
    """What the plan's way to select needs of a training set: sums of its standardised, unclipped rows, or counts by quantile."""
    p = len(plan.features)
    if plan.selection == "none":
        return {}
    one, two = ((x[:, :p] - scale[0][:p]) / scale[1][:p] for x in (a, b))
    if plan.selection == "mi":
        bins = lambda x: np.concatenate([np.bincount(np.searchsorted(edges[j], x[:, j]), minlength=BINS) for j in range(p)])
        return {"mi": np.concatenate([bins(a), bins(b)])}
    if plan.selection == "mml":
        return {"y": M.gram(np.column_stack([np.concatenate([one, two]), np.repeat([0.0, 1.0], [len(one), len(two)])]))}
    return {str(t): M.gram((two - one)[interval == t]) for t in (1, 2, 0)}


def _information(counts: np.ndarray) -> float:
    """Mutual information of a feature's quantile bins with the visit, from counts by visit and bin."""
    n = counts.sum()
    if not n:
        return 0.0
    joint = counts / n
    alone = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
    return float((joint[joint > 0] * np.log(joint[joint > 0] / alone[joint > 0])).sum())


def _select(plan: Plan, grams: dict[str, np.ndarray], k: int, scale: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Numbers of the features that training set k selects, best first; its own rows decide alone."""
    p, names = len(plan.features), list(plan.features)
    mine = {key.rpartition("/")[2]: v for key, v in grams.items() if key.startswith(f"{k}/select/")}
    if plan.selection == "none" or not mine:
        return list(range(p))
    mean, sd = scale[0][:p], scale[1][:p]
    if plan.selection == "mi":
        value = [_information(mine["mi"].reshape(2, p, BINS)[:, j]) for j in range(p)]
        # equal counts in another order differ in their last digits only
        ranked = sorted(range(p), key=lambda j: (-round(value[j], 9), names[j]))
        if plan.groups:
            return list(dict.fromkeys(j for g in plan.groups for j in [j for j in ranked if names[j] in g][: plan.k]))
        return ranked[: plan.k]
    if plan.selection == "mml":
        # back to the raw scale, on which message lengths are defined
        back = np.diag(np.concatenate([[1.0], sd, [1.0]]))
        back[0, 1:-1] = mean
        return [names.index(f) for f, _ in K.mml_forward(back.T @ M.square(mine["y"]) @ back, names)][: plan.k]
    back = np.diag(np.append(1.0, sd))
    deltas = {t: back @ M.square(v) @ back for t, v in mine.items()}
    if plan.selection == "sparse_srm":
        penalty, l1_ratio, least = plan.sparse
        w = K.sparse_srm([deltas[t] for t in ("1", "2", "0")], penalty, l1_ratio)
        return [j for j in sorted(range(p), key=lambda j: (-abs(w[j]), names[j])) if abs(w[j]) > least][: plan.k]
    d = []
    for t in ("1", "2"):
        n, mu, cov = K.split(deltas[t])
        spread = np.sqrt(np.maximum(np.diag(cov), 0)) if n >= 2 else np.full(p, np.nan)
        d.append(np.where(spread > 0, mu / np.where(spread > 0, spread, 1), np.nan))
    both = np.where(np.isnan(d[0]), d[1], np.where(np.isnan(d[1]), d[0], (d[0] + d[1]) / 2))
    if plan.selection == "progression_univariate":
        last = lambda x: (bool(np.isnan(x)), 0.0 if np.isnan(x) else float(x))
        return sorted(range(p), key=lambda j: (last(-abs(both[j])), last(abs(d[0][j] - d[1][j])), names[j]))[: plan.k]
    _, _, cov = K.split(sum(deltas.values()))
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.where(sd > 0, sd, 1)[:, None] / np.where(sd > 0, sd, 1)[None, :]
    return [names.index(f) for f in K.mrmr(both, corr, names, plan.k, plan.redundancy)]


def _fit(plan: Plan, c: Candidate, grams: dict[str, np.ndarray], k: int, chosen: list[int]) -> tuple[np.ndarray, float] | None:
    """Weights of all columns of the design (0 where not selected) and the intercept."""
    p, q = len(plan.features), len(plan.modulators) if plan.kind == "interaction" else 0
    columns = np.array([*chosen, *[p + j * q + m for j in chosen for m in range(q)]], dtype=np.int64)
    rows = np.append(0, columns + 1)
    if plan.kind == "regression":
        own = {key: g[np.ix_(r, r)] for key, g in grams.items() if key.startswith(f"{k}/") and "/select/" not in key for r in [np.append(rows, len(g) - 1) if key.endswith("/y") else rows]}
    else:
        own = {key: g[np.ix_(rows, rows)] for key, g in grams.items() if key.startswith(f"{k}/") and "/select/" not in key}
    out = np.zeros(p + p * q)
    if not len(columns):
        return out, 0.0
    found = _fit_columns(plan, c, own, k)
    if found is None:
        return None
    out[columns] = found[0]
    return out, found[1]


def _fit_columns(plan: Plan, c: Candidate, grams: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, float] | None:
    at = plan.clips.index(np.inf if c.clip is None else c.clip)
    d = grams.get(f"{k}/{at}/d")
    if d is None or d[0, 0] < 2:
        return None
    if plan.kind == "srm":
        return K.srm_weights(d, c.ridge, c.shrinkage), 0.0
    if plan.kind == "interaction":
        return K.constant_net(d, c.alpha, c.l1_ratio), 0.0
    if plan.kind == "regression":
        return K.elastic_net(grams[f"{k}/{at}/y"], c.alpha, c.l1_ratio)
    w = K.lda_weights(grams[f"{k}/{at}/1"], grams[f"{k}/{at}/2"], c.shrinkage)
    return None if w is None else ((-w if w @ d[0, 1:] < 0 else w), 0.0)


def _diagnose(rows: DataFrame, plan: Plan, sets: list, scales: dict, fits: dict) -> pd.DataFrame:
    """n, sum, sum of squares and positives of validation deltas (and squared errors) by set, candidate and interval."""

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = _arrays(pdf)
        folds = _folds(pdf)
        interval = pdf["interval"].to_numpy()
        out = {}
        for k, s in enumerate(sets):
            if s[2] < 0:
                continue
            _, held = _masks(folds, plan, s)
            for clip in plan.clips:
                one, two = _scaled(plan, a[held], scales[k], clip), _scaled(plan, b[held], scales[k], clip)
                for j, c in enumerate(plan.candidates):
                    if (np.inf if c.clip is None else c.clip) != clip or (k, j) not in fits:
                        continue
                    w, w0 = fits[k, j]
                    d = (two - one) @ w
                    e = np.zeros(len(d)) if plan.kind != "regression" else (one @ w + w0 - a[held, -1]) ** 2 + (two @ w + w0 - b[held, -1]) ** 2
                    for t in (0, 1, 2):
                        m = interval[held] == t
                        out[f"{k}/{j}/{t}"] = np.array([m.sum(), d[m].sum(), (d[m] ** 2).sum(), (d[m] > 0).sum(), e[m].sum()], dtype=float)
        return out

    return pd.DataFrame([(*map(int, key.split("/")), *v) for key, v in M.sums(rows, part).items()], columns=["set", "candidate_idx", "interval", "n", "s", "q", "pos", "err"])


def _effect(g: pd.DataFrame) -> float:
    n, s, q = g[["n", "s", "q"]].sum()
    if n < 2:
        return np.nan
    var = (q - s * s / n) / (n - 1)
    return s / n / np.sqrt(var) if var > 1e-300 else np.nan


def _summaries(plan: Plan, sets: list, seen: pd.DataFrame, metric: str) -> pd.DataFrame:
    """One row a repeat, outer fold and candidate with what the choice among candidates needs."""
    seen = seen.assign(repeat=[sets[k][0] for k in seen["set"]], outer=[sets[k][1] for k in seen["set"]])
    out = []
    for (r, o, j), g in seen.groupby(["repeat", "outer", "candidate_idx"]):
        d12, d23 = _effect(g[g.interval == 1]), _effect(g[g.interval == 2])
        each = np.array([x for _, f in g.groupby("set") if np.isfinite(x := _effect(f))])
        p = [h.pos.sum() / h.n.sum() if h.n.sum() else np.nan for h in (g[g.interval == 1], g[g.interval == 2])]
        rmse = np.sqrt(g.err.sum() / max(1, 2 * g.n.sum()))
        mean = {"annual_mean_dz": (d12 + d23) / 2, "d": each.mean() if len(each) else np.nan, "rmse": -rmse}[metric]
        se = each.std(ddof=1) / np.sqrt(len(each)) if len(each) > 1 and metric != "rmse" else 0.0
        out.append((r, o, j, mean if np.isfinite(mean) else float("-inf"), se, d12, d23, abs(d12 - d23), float(np.mean(p)), float(len(plan.features))))
    return pd.DataFrame(out, columns=["repeat", "outer", "candidate_idx", "mean_validation_annual_dz", "se_validation_dz", "dz_v1_v2", "dz_v2_v3", "annual_interval_gap", "p_progression", "feature_count"])


def fit_whole(pair_visits: DataFrame, plan: Plan, **names: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, float] | None]:
    """Means and spreads of all complete pairs, and the first candidate's weights of the design with the intercept."""
    rows = kept(prepare(pair_visits, plan, **names))
    scales = scales_of(rows, plan, [ALL])
    grams = _grams(rows, plan, [ALL], scales)
    return scales[0], _fit(plan, plan.candidates[0], grams, 0, _select(plan, grams, 0, scales[0]))


def cross_validate(pair_visits: DataFrame, plan: Plan, metric: str = "annual_mean_dz", **names: str) -> Validated:
    """Out-of-fold scores, with more than one candidate the table of candidates with the chosen ones, each fold's features and coefficients.

    Scores: repeat, fold, pair_id, subject, visit, score (and target for a regression).
    Coefficients: of the chosen candidate on the fold's standard scale, 0 where not selected.
    A fold whose training set cannot be fitted gives no scores. Incomplete pairs, and
    pairs without both visits, take no part.
    """
    spark = pair_visits.sparkSession
    rows = kept(prepare(pair_visits, plan, **names))
    nested = len(plan.candidates) > 1
    sets = _sets(plan, nested)
    scales = scales_of(rows, plan, sets)
    grams = _grams(rows, plan, sets, scales)
    selected = {k: _select(plan, grams, k, scales[k]) for k in range(len(sets))}
    fits = {(k, j): f for k in range(len(sets)) for j, c in enumerate(plan.candidates) if (f := _fit(plan, c, grams, k, selected[k])) is not None}
    chosen: dict[tuple[int, int], int] = {(r, o): 0 for r, o, i in sets if i < 0}
    table = None
    if nested:
        found = _summaries(plan, sets, _diagnose(rows, plan, sets, scales, fits), metric)
        candidates = spark.createDataFrame(found)
        picked = hierarchical_choice(candidates, keys=["repeat", "outer"])
        # a row per outer fold
        chosen |= {(x["repeat"], x["outer"]): x["candidate_idx"] for x in picked.select("repeat", "outer", "candidate_idx").collect()}
        table = candidates.join(picked.select("repeat", "outer", "candidate_idx", F.lit(True).alias("chosen")), ["repeat", "outer", "candidate_idx"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    last = [(k, s) for k, s in enumerate(sets) if s[2] < 0]
    target = plan.target is not None and plan.kind == "regression"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = _arrays(pdf)
            folds = _folds(pdf)
            for k, s in last:
                j = chosen[s[0], s[1]]
                if (k, j) not in fits:
                    continue
                c, (w, w0) = plan.candidates[j], fits[k, j]
                _, held = _masks(folds, plan, s)
                for v, x in ((1, a), (2, b)):
                    z = _scaled(plan, x[held], scales[k], np.inf if c.clip is None else c.clip) @ w + w0
                    out = pd.DataFrame({"repeat": s[0], "fold": s[1], "pair_id": pdf["pair_id"].to_numpy()[held], "subject": pdf["subject"].to_numpy()[held], "visit": v, "score": z})
                    yield out.assign(target=x[held, -1]) if target else out

    kind = "repeat int, fold int, pair_id string, subject string, visit int, score double" + (", target double" if target else "")
    own = spark.createDataFrame([(s[0], s[1], [plan.features[j] for j in selected[k]]) for k, s in last], "repeat int, fold int, features array<string>")
    terms = [*plan.features, *[f"{f} x {m}" for f in plan.features for m in plan.modulators if plan.kind == "interaction"]]
    coefs = [(s[0], s[1], chosen[s[0], s[1]], t, float(w)) for k, s in last if (k, chosen[s[0], s[1]]) in fits for t, w in zip(terms, fits[k, chosen[s[0], s[1]]][0])]
    weights = spark.createDataFrame(coefs, "repeat int, fold int, candidate_idx int, term string, coef double")
    return Validated(rows.mapInPandas(score, kind), table, own, weights)


def grid(**axes: Sequence) -> tuple[Candidate, ...]:
    """All candidates of a grid, the first axis slowest."""
    from itertools import product

    return tuple(Candidate(**dict(zip(axes, values))) for values in product(*axes.values()))
