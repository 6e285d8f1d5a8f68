"""Small networks on visit pairs, in NumPy: forward passes, gradients, dropout and early stopping.

A network is a list of branches, each two linear layers with a ReLU between (and after, if
asked), fused by one linear layer to a score, or by a layer with a ReLU first; an absent
branch counts as zeros. Further linear heads may predict clinical columns from what the
score is made of. The pair model is the fusion of one branch: its output is
score(visit 2) - score(visit 1), so it is antisymmetric. Training minimises
-mean / (sd + eps) of the score changes over all pairs at once, plus the heads' mean squared
errors by their weights. The gradient of the first in a change is linear in the change,
and errors add up over rows, so a few sums over the rows, wherever they are, give the
gradient of the whole: an epoch is one scan for all folds, and no task sees more than a
batch. Dropout is a function of seed, epoch, pair, visit and unit, so neither the
partitioning nor a retried task changes it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import moments as M
from tideline.operators.lineage import kept
from tideline.operators.resample import hash_fold, hash_number

EPS = 1e-6
#: The training set of all rows.
WHOLE = -1


@dataclass(frozen=True)
class Network:
    """branches: columns of each; hidden and out: widths of a branch's two layers, one for all or one a branch.

    relu_out: a ReLU after the second layer too. head: width of the fused layer before the
    score, 0 for none. dropout: share of units that a training pass leaves out after each
    ReLU. clinical: (name, column, weight in the loss) of each clinical head.
    """

    branches: tuple[tuple[int, ...], ...]
    hidden: int | tuple[int, ...] = 8
    out: int | tuple[int, ...] = 4
    epochs: int = 60
    patience: int = 8
    rate: float = 1e-2
    decay: float = 1e-4
    validation: float = 0.2
    seed: int = 42
    names: tuple[str, ...] = field(default=())
    relu_out: bool = False
    head: int = 0
    dropout: float = 0.0
    clinical: tuple[tuple[str, int, float], ...] = ()

    def widths(self, k: int) -> tuple[int, int]:
        return tuple(w if isinstance(w, int) else w[k] for w in (self.hidden, self.out))

    @property
    def present(self) -> list[int]:
        return [k for k, cols in enumerate(self.branches) if cols]


def start(net: Network) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(net.seed)
    p = {}
    for k, cols in enumerate(net.branches):
        if cols:
            hidden, out = net.widths(k)
            p[f"a{k}"], p[f"b{k}"] = rng.normal(0, (2 / len(cols)) ** 0.5, (len(cols), hidden)), np.zeros(hidden)
            p[f"c{k}"], p[f"d{k}"] = rng.normal(0, (1 / hidden) ** 0.5, (hidden, out)), np.zeros(out)
            if not net.head:
                p[f"w{k}"] = rng.normal(0, (1 / out) ** 0.5, out)
    fused = sum(net.widths(k)[1] for k in net.present)
    if net.head:
        p["h"], p["i"] = rng.normal(0, (2 / max(fused, 1)) ** 0.5, (fused, net.head)), np.zeros(net.head)
        p["w"] = rng.normal(0, (1 / net.head) ** 0.5, net.head)
    for name, _, _ in net.clinical:
        p[f"u_{name}"], p[f"v_{name}"] = rng.normal(0, (1 / max(net.head or fused, 1)) ** 0.5, net.head or fused), np.zeros(1)
    return p


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def masks(net: Network, ids: np.ndarray, visit: int, epoch: int) -> dict[str, np.ndarray]:
    """What dropout multiplies the units of each layer by: 0, or 1 / (1 - share) where they stay."""
    if not net.dropout:
        return {}
    layers = {f"{t}{k}": net.widths(k)[n] for k in net.present for n, t in enumerate("ro") if t == "r" or net.relu_out}
    if net.head:
        layers["t"] = net.head
    out = {}
    for number, (layer, units) in enumerate(sorted(layers.items())):
        with np.errstate(over="ignore"):
            salt = _mix(np.uint64(net.seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((epoch * 2 + visit - 1) << 32) + (number << 16)) + np.arange(units, dtype=np.uint64))
            u = _mix(ids.astype(np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03) ^ salt)
        out[layer] = ((u >> np.uint64(11)) / float(1 << 53) >= net.dropout) / (1 - net.dropout)
    return out


def forward(net: Network, p: dict[str, np.ndarray], x: np.ndarray, drop: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict]:
    """Scores of rows, and what the gradient needs; its "heads" are the clinical predictions."""
    score, kept, drop = np.zeros(len(x)), {}, drop or {}
    for k, cols in enumerate(net.branches):
        if cols:
            h = x[:, cols] @ p[f"a{k}"] + p[f"b{k}"]
            r = np.maximum(h, 0) * drop.get(f"r{k}", 1.0)
            s = r @ p[f"c{k}"] + p[f"d{k}"]
            o = np.maximum(s, 0) * drop.get(f"o{k}", 1.0) if net.relu_out else s
            if not net.head:
                score = score + o @ p[f"w{k}"]
            kept[k] = (x[:, cols], h, r, s, o)
    f = np.concatenate([kept[k][4] for k in net.present], axis=1) if net.present else np.zeros((len(x), 0))
    z, t = None, f
    if net.head:
        z = f @ p["h"] + p["i"]
        t = np.maximum(z, 0) * drop.get("t", 1.0)
        score = t @ p["w"]
    return score, {"branches": kept, "fused": f, "z": z, "t": t, "drop": drop, "heads": {name: t @ p[f"u_{name}"] + p[f"v_{name}"][0] for name, _, _ in net.clinical}}


def backward(net: Network, p: dict[str, np.ndarray], kept: dict, g: np.ndarray, heads: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradient of sum(g * score), plus sum(heads[name] * prediction) of each clinical head."""
    out, heads, drop = {}, heads or {}, kept["drop"]
    gt = np.outer(g, p["w"]) if net.head else np.concatenate([np.outer(g, p[f"w{k}"]) for k in net.present], axis=1) if net.present else np.zeros((len(g), 0))
    for name, _, _ in net.clinical:
        e = heads.get(name, np.zeros(len(g)))
        out |= {f"u_{name}": kept["t"].T @ e, f"v_{name}": np.array([e.sum()])}
        gt = gt + np.outer(e, p[f"u_{name}"]) if name in heads else gt
    if net.head:
        out["w"] = kept["t"].T @ g
        gz = gt * drop.get("t", 1.0) * (kept["z"] > 0)
        out |= {"h": kept["fused"].T @ gz, "i": gz.sum(axis=0)}
        gt = gz @ p["h"].T
    at = 0
    for k, (x, h, r, s, o) in kept["branches"].items():
        go = gt[:, at : at + o.shape[1]]
        at += o.shape[1]
        if not net.head:
            out[f"w{k}"] = o.T @ g
        if net.relu_out:
            go = go * drop.get(f"o{k}", 1.0) * (s > 0)
        gr = (go @ p[f"c{k}"].T) * drop.get(f"r{k}", 1.0) * (h > 0)
        out |= {f"c{k}": r.T @ go, f"d{k}": go.sum(axis=0), f"a{k}": x.T @ gr, f"b{k}": gr.sum(axis=0)}
    return out


def loss(delta: np.ndarray) -> tuple[float, np.ndarray]:
    """-mean / (sd + eps) and its gradient; 0 for fewer than two pairs."""
    n = len(delta)
    if n < 2:
        return 0.0, np.zeros(n)
    mean, sd = delta.mean(), delta.std(ddof=1)
    spread = sd + EPS
    slope = (delta - mean) / ((n - 1) * sd) if sd > 0 else np.zeros(n)
    return -mean / spread, -(1 / n) / spread + mean / spread**2 * slope


@dataclass
class Training:
    """Parameters of one fold on their way, with Adam's averages and the best ones so far."""

    p: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    best: dict[str, np.ndarray]
    least: float = np.inf
    waited: int = 0
    steps: int = 0

    @classmethod
    def of(cls, net: Network) -> Training:
        p = start(net)
        return cls(p, {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, {k: x.copy() for k, x in p.items()})

    def step(self, net: Network, gradient: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k in self.p:
            d = gradient[k] + net.decay * self.p[k]
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * d, 0.999 * self.v[k] + 0.001 * d * d
            self.p[k] = self.p[k] - net.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)

    def judge(self, net: Network, value: float) -> bool:
        """Keep the parameters if validation is better; False once it has not been for too long."""
        if value < self.least - 1e-6:
            self.least, self.best, self.waited = value, {k: x.copy() for k, x in self.p.items()}, 0
        else:
            self.waited += 1
        return self.waited < net.patience


def change_sums(net: Network, p: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, drop: Sequence[dict[str, np.ndarray]] = ({}, {}), targets: Sequence[np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Of some pairs: n, sum and sum of squares of the changes, and the sums of their gradients, plain and times the change.

    targets: of each visit, the clinical columns in the order of the heads. Then "e" has
    rows and weighted squared errors, and "errors" half the gradient of the latter.
    """
    (s1, k1), (s2, k2) = forward(net, p, one, drop[0]), forward(net, p, two, drop[1])
    d = s2 - s1
    out = {"d": np.array([len(d), d.sum(), (d * d).sum()])}
    for name, g in (("plain", np.ones(len(d))), ("times", d)):
        up, down = backward(net, p, k2, g), backward(net, p, k1, g)
        out |= {f"{name}/{k}": (up[k] - down[k]).ravel() for k in p}
    if targets is not None and any(w for _, _, w in net.clinical):
        total, sums = 0.0, {k: np.zeros(x.size) for k, x in p.items()}
        for kept_, target in ((k1, targets[0]), (k2, targets[1])):
            miss = {name: kept_["heads"][name] - target[:, n] for n, (name, _, _) in enumerate(net.clinical)}
            total += sum(w * float((miss[name] ** 2).sum()) for name, _, w in net.clinical)
            part = backward(net, p, kept_, np.zeros(len(d)), {name: w * miss[name] for name, _, w in net.clinical})
            sums = {k: v + part[k].ravel() for k, v in sums.items()}
        out |= {"e": np.array([2 * len(d), total])} | {f"errors/{k}": v for k, v in sums.items()}
    return out


def _value(d: np.ndarray) -> tuple[float, float, float]:
    """-mean / (sd + eps) from n, sum and sum of squares, and its gradient in a change as (plain, times the change)."""
    n = d[0]
    if n < 2:
        return 0.0, 0.0, 0.0
    mean = d[1] / n
    sd = np.sqrt(max((d[2] - n * mean * mean) / (n - 1), 0.0))
    spread = sd + EPS
    times = mean / spread**2 / ((n - 1) * sd) if sd > 0 else 0.0
    return -mean / spread, -(1 / n) / spread - times * mean, times


def _error(sums: dict[str, np.ndarray]) -> float:
    """The heads' weighted mean squared errors."""
    n, total = sums.get("e", (0.0, 0.0))
    return total / n if n else 0.0


def whole_gradient(p: dict[str, np.ndarray], sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The gradient of the loss of all pairs from their summed ``change_sums``."""
    _, plain, times = _value(sums["d"])
    out = {k: (plain * sums[f"plain/{k}"] + times * sums[f"times/{k}"]).reshape(x.shape) for k, x in p.items()}
    if "e" in sums and sums["e"][0]:
        out = {k: v + (2 / sums["e"][0] * sums[f"errors/{k}"]).reshape(v.shape) for k, v in out.items()}
    return out


@dataclass(frozen=True)
class Fitted:
    """Parameters of a training set with the means and spreads that standardise its columns."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    sd: np.ndarray


def _rows(pairs: DataFrame, net: Network) -> DataFrame:
    return kept(pairs.select("pair_id", "subject", "a", "b", F.col("outer")[0].alias("_o"), (hash_fold(F.col("subject"), 1000, net.seed) < round(1000 * net.validation)).alias("_v"), hash_number(F.col("pair_id")).alias("_id")))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["a"].to_numpy()).astype(float), np.stack(pdf["b"].to_numpy()).astype(float), pdf["_o"].to_numpy(), pdf["_v"].to_numpy(bool), pdf["_id"].to_numpy()


def _fit(rows: DataFrame, net: Network, folds: Sequence[int], train_clinical: bool) -> dict[int, Fitted]:
    if any(w for _, _, w in net.clinical) and not train_clinical:
        raise ValueError("clinical columns take no part in training unless train_clinical asks for it")
    columns = [c for _, c, _ in net.clinical]

    def moments(pdf: pd.DataFrame, centre: np.ndarray | float = 0.0) -> dict[str, np.ndarray]:
        a, b, fold, _, _ = _arrays(pdf)
        out = {}
        for o in folds:
            x = np.concatenate([a[fold != o], b[fold != o]]) - centre
            out[str(o)] = np.concatenate([[len(x), o == WHOLE or (fold == o).sum()], x.sum(axis=0), (x * x).sum(axis=0)])
        return out

    first = M.sums(rows, moments, small=True)
    width = (max((len(v) for v in first.values()), default=2) - 2) // 2
    total = sum(first.values(), np.zeros(2 + 2 * width))
    centre = total[2 : 2 + width] / max(total[0], 1)
    scales, live = {}, {}
    # squares are summed around the mean of all rows
    for o, v in M.sums(rows, lambda pdf: moments(pdf, centre), small=True).items():
        if v[0] and v[1]:
            mean = v[2 : 2 + width] / v[0]
            sd = np.sqrt(np.maximum(v[2 + width :] / v[0] - mean**2, 0))
            scales[int(o)], live[int(o)] = (centre + mean, np.where(sd > 0, sd, 1.0)), Training.of(net)
    done: dict[int, Training] = {}
    for epoch in range(net.epochs + 1):

        def part(pdf: pd.DataFrame, now: dict = {o: t.p for o, t in live.items()}, epoch: int = epoch) -> dict[str, np.ndarray]:  # noqa: B006
            a, b, fold, held, ids = _arrays(pdf)
            out = {}
            for o, p in now.items():
                mean, sd = scales[o]
                for name, m in (("train", (fold != o) & ~held), ("held", (fold != o) & held)):
                    drop = (masks(net, ids[m], 1, epoch), masks(net, ids[m], 2, epoch)) if name == "train" else ({}, {})
                    targets = (a[m][:, columns], b[m][:, columns]) if columns else None
                    sums = change_sums(net, p, (a[m] - mean) / sd, (b[m] - mean) / sd, drop, targets)
                    out |= {f"{o}/{name}/{k}": v for k, v in sums.items() if name == "train" or k in ("d", "e")}
            return out

        found = M.sums(rows, part, small=True) if live else {}
        of = lambda o, name: {k.removeprefix(f"{o}/{name}/"): v for k, v in found.items() if k.startswith(f"{o}/{name}/")}
        for o, t in list(live.items()):
            # the scan has the validation of the step before and the gradient of the next
            if epoch and not t.judge(net, _value((held := of(o, "held"))["d"])[0] + _error(held)):
                done[o] = live.pop(o)
            elif epoch < net.epochs:
                t.step(net, whole_gradient(t.p, of(o, "train")))
    return {o: Fitted(t.best, *scales[o]) for o, t in (done | live).items()}


def fit_network(pairs: DataFrame, net: Network, train_clinical: bool = False) -> Fitted:
    """Parameters from all pairs as ``cv.prepare`` makes them, stopped early by a share of their subjects.

    No pairs give the parameters at the start. Clinical columns must not train a model of
    progression, so heads with a weight raise unless ``train_clinical`` is set.
    """
    found = _fit(_rows(pairs, net), net, [WHOLE], train_clinical)
    width = max([c + 1 for b in net.branches for c in b], default=0)
    return found.get(WHOLE, Fitted(start(net), np.zeros(width), np.ones(width)))


def network_cv(pairs: DataFrame, net: Network, folds: int = 5, train_clinical: bool = False) -> DataFrame:
    """Out-of-fold scores (pair_id, subject, visit, score, and a column a clinical head) of pairs as ``cv.prepare`` makes them.

    Each fold is standardised by its training rows and stops early by a share of their
    subjects, chosen by hash. All folds train together, one scan an epoch. Clinical heads
    predict on the columns' own scale; with a weight they need ``train_clinical``.
    """
    rows = _rows(pairs, net)
    fitted = _fit(rows, net, range(folds), train_clinical)
    heads = [name for name, _, _ in net.clinical]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, fold, _, _ = _arrays(pdf)
            for o, f in fitted.items():
                m = fold == o
                for v, x in ((1, a), (2, b)):
                    s, tape = forward(net, f.p, (x[m] - f.mean) / f.sd)
                    yield pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy()[m], "subject": pdf["subject"].to_numpy()[m], "visit": v, "score": s} | {h: tape["heads"][h] for h in heads})

    return rows.mapInPandas(score, "pair_id string, subject string, visit int, score double" + "".join(f", `{h}` double" for h in heads))


def _slope(after: np.ndarray, after0: np.ndarray, before: np.ndarray, before0: np.ndarray) -> np.ndarray:
    """The rescale rule: change of a unit's output by change of its input, the gradient where the input hardly changes."""
    d = before - before0
    near = np.abs(d) < 1e-12
    return np.where(near, (before > 0).astype(float), (after - after0) / np.where(near, 1.0, d))


def attributions(net: Network, p: dict[str, np.ndarray], x: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
    """What each column adds to each row's score beside the mean score of the background, and that mean.

    Differences from a background row go back through the layers by the rescale rule and
    are averaged over the background; a row's contributions add up to its score less that mean.
    """
    total = np.zeros(x.shape)
    (s0, k0), (_, k1) = forward(net, p, background), forward(net, p, x)
    for q in range(len(background)):
        if net.head:
            back = p["w"] * _slope(k1["t"], k0["t"][q], k1["z"], k0["z"][q])
            back = back @ p["h"].T
        else:
            back = np.broadcast_to(np.concatenate([p[f"w{k}"] for k in net.present]) if net.present else np.zeros(0), k1["fused"].shape)
        at = 0
        for k in net.present:
            (_, h, r, s, o), (_, h0, r0, z0, o0) = k1["branches"][k], k0["branches"][k]
            m = back[:, at : at + o.shape[1]]
            at += o.shape[1]
            if net.relu_out:
                m = m * _slope(o, o0[q], s, z0[q])
            m = (m @ p[f"c{k}"].T) * _slope(r, r0[q], h, h0[q])
            cols = list(net.branches[k])
            total[:, cols] += (x[:, cols] - background[q, cols]) * (m @ p[f"a{k}"].T)
    return total / max(len(background), 1), float(s0.mean()) if len(background) else 0.0


def deep_shap(df: DataFrame, net: Network, fitted: Fitted, columns: Sequence[str], keep: Sequence[str], background: DataFrame, most: int = 100) -> DataFrame:
    """Contributions of every column to the score of every row: keep..., feature, shap, base and score, one scan.

    The background is a bounded sample: up to ``most`` rows of ``background`` (the columns
    alone) of least hash, so that any run takes the same. Rows and background need all
    columns. base plus a row's contributions is its score; a column in no branch has 0.
    """
    names = list(columns)
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in names]).cast("binary"))
    known = background.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna().orderBy(key, *names).limit(most)
    mean, sd = fitted.mean[: len(names)], fitted.sd[: len(names)]
    back = (np.array([list(r) for r in known.collect()], dtype=float).reshape(-1, len(names)) - mean) / sd
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                x = (part[names].to_numpy(float) - mean) / sd
                shap, base = attributions(net, fitted.p, x, back)
                score = forward(net, fitted.p, x)[0]
                for j, c in enumerate(names):
                    yield part[list(keep)].assign(feature=c, shap=shap[:, j], base=base, score=score)

    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", feature string, shap double, base double, score double")


def modality_shap(shap: DataFrame, modalities: dict[str, Sequence[str]]) -> DataFrame:
    """modality and the sum over its features of their mean absolute contribution; 0 for one without features."""
    spark = shap.sparkSession
    named = spark.createDataFrame([(m, f) for m, fs in modalities.items() for f in fs], "modality string, feature string")
    by = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("_s")).join(F.broadcast(named), "feature").groupBy("modality").agg(F.sum("_s").alias("mean_abs_shap"))
    return spark.createDataFrame([(m,) for m in modalities], "modality string").join(by, "modality", "left").select("modality", F.coalesce("mean_abs_shap", F.lit(0.0)).alias("mean_abs_shap"))


def network_scores(df: DataFrame, net: Network, p: dict[str, np.ndarray], columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Scores of rows by fixed parameters, batch by batch."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[list(keep)].assign(score=forward(net, p, pdf[list(columns)].to_numpy(float))[0])

    return df.select(*keep, *columns).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")
