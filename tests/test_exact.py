"""Exact quantiles, nearest-neighbour information, left-out features, site models, elastic-net paths, dropout, heads and contributions against plain NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import cv as C
from tideline.operators import effects as E
from tideline.operators import importance as I
from tideline.operators import information as T
from tideline.operators import kernels as K
from tideline.operators import netpath as P
from tideline.operators import neural as N
from tideline.operators import quantiles as Q
from tideline.operators import stability as S
from tideline.plans import fixtures as X

FOUR = ["f_click", "f_error", "f_purchase", "f_view"]


# quantiles


def test_ordered_bits_order_as_values_do():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    bits = Q.ordered_bits(x)
    assert (np.diff(bits.astype(object)) > 0).all() and [Q.from_bits(int(b)) for b in bits] == x.tolist()
    assert Q.ordered_bits(np.array([-0.0]))[0] == Q.ordered_bits(np.array([0.0]))[0] and Q.ordered_bits(np.array([np.nan]))[0] > bits[-1]


@pytest.mark.parametrize("bits", [Q.BITS, 4])
def test_quantiles_equal_percentile(spark, bits, monkeypatch):
    # with digits of four bits a group of a thousand values takes several scans
    monkeypatch.setattr(Q, "BITS", bits)
    rng = np.random.default_rng(4)
    n = 3000
    a = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * np.exp(20 * rng.normal(size=n)))
    rows = [(None if rng.random() < 0.1 else float(a[k]), float(k % 3 - 1), None if k % 5 == 0 else int(k % 4), 1.0 if k == 7 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, g int, once double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.731, 1.0]
    got = {(r.g, r.feature): (r.n, r.q) for r in Q.quantile_table(df, ["a", "b", "once"], shares, ["g"]).collect()}
    want = {}
    for c in ("a", "b", "once"):
        for r in df.groupBy("g").agg(F.count(c).alias("n"), F.percentile(c, F.array(*map(F.lit, shares))).alias("q")).collect():
            if r.n:
                want[r.g, c] = (r.n, r.q)
    assert got == want
    assert Q.exact_quantiles(df.where("false"), ["a"], [0.5]) == {}
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),)], "x double")
    low, mid, top = Q.exact_quantiles(nan, ["x"], [0.0, 0.5, 1.0])["", "x"][1]
    assert (low, mid) == (-math.inf, 1.0) and math.isnan(top)


# information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def plain_information(x, y, k):
    n = len(x)
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1 : k]
    near = lambda v: ((v < r) | ((r == 0) & (v == 0))).sum(axis=1)
    return max(0.0, psi(n) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(near(dx), near(dy))]))


@pytest.mark.parametrize("cell", [T.CELL, 20])
def test_information_equals_all_pairs(spark, cell):
    rng = np.random.default_rng(0)
    n = 400
    y = rng.normal(size=n)
    x = {"near": y + rng.normal(size=n), "whole": np.round(2 * y), "hot": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)), "wide": np.exp(4 * rng.normal(size=n)), "same/1": y.copy(), "flat": np.zeros(n), "apart": np.where(np.arange(n) < 3, 1e6, rng.normal(size=n))}
    df = spark.createDataFrame(pd.DataFrame(x | {"y": y}))
    # a missing value is the median, a row without target takes no part
    gaps = df.withColumn("near", F.when(F.col("near") > 1.5, F.lit(float("nan"))).otherwise(F.col("near"))).unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double")))
    fill = np.where(x["near"] > 1.5, np.nan, x["near"])
    x["near"] = np.where(np.isnan(fill), np.nanmedian(fill), fill)
    got = {r.feature: (r.n, r.mi) for r in T.knn_information(gaps, list(x), "y", 3, cell).collect()}
    for f, v in x.items():
        assert got[f] == (n, pytest.approx(plain_information(v, y, 3), abs=1e-9)), f


def test_information_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (None, 1.0)], "a double, y double")
    assert [tuple(r) for r in T.knn_information(df, ["a"], "y").collect()] == [("a", 3, None)]
    assert [tuple(r) for r in T.knn_information(df.where("false"), ["a"], "y").collect()] == [("a", 0, None)]


def test_interval_ends_agree_with_rounded_differences():
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=500) * np.exp(3 * rng.normal(size=500)), np.round(rng.normal(size=500) * 3), rng.normal(size=500) * 1e-3 + 1):
        d = np.abs(x[:, None] - x)
        r = np.sort(d, axis=1)[:, 3]
        low, high = T.interval_ends(x, r)
        s = np.sort(x)
        got = np.searchsorted(s, high, "right") - np.searchsorted(s, low, "right")
        assert (got == ((d < r[:, None]) | ((r[:, None] == 0) & (d == 0))).sum(axis=1)).all()


# left-out features and site models


def test_left_out_features_equal_one_cross_validation_each(spark, sf):
    """Pairs that lack one feature only train and are scored where that one is left out, as in a cross-validation of its own."""
    rows = X.pair_visits(spark, sf)
    rows = rows.withColumn("f_click", F.when(F.crc32(F.col("pair_id").cast("binary")) % 7 == 0, None).otherwise(F.col("f_click"))).withColumn("f_view", F.when(F.crc32(F.col("pair_id").cast("binary")) % 11 == 1, float("nan")).otherwise(F.col("f_view")))
    rows = rows.withColumn("f_error", F.col("f_error") + 1e4)
    got = {r.feature: r for r in I.leave_one_feature_out(rows, FOUR).collect()}

    def annual(features):
        return E.annual_diagnostics(E.adjacent_effects(C.cross_validate(rows, C.Plan("srm", tuple(features))).scores, pooled=None)).first()

    full = annual(FOUR).annual_mean_dz
    for f in FOUR:
        want = annual([x for x in FOUR if x != f])
        assert (got[f].dz_v1_v2, got[f].dz_v2_v3) == (pytest.approx(want.dz_v1_v2, abs=1e-6), pytest.approx(want.dz_v2_v3, abs=1e-6))
        assert got[f].performance_loss == pytest.approx(full - want.annual_mean_dz, abs=1e-6)


def test_left_out_features_of_nothing(spark):
    df = spark.createDataFrame([], "pair_id string, subject string, visit int, a double, b double")
    assert [tuple(r) for r in I.leave_one_feature_out(df, ["a", "b"]).collect()] == [("a", None, None, None, None), ("b", None, None, None, None)]


def test_site_models_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 120
    z = rng.normal(size=(n, 2)) + 1e4
    site = rng.integers(0, 4, n)
    y = z @ [0.5, -1] + site * 0.8 + rng.normal(size=n)
    data = pd.DataFrame({"site": [f"s{k}" for k in site], "u": z[:, 0], "v": z[:, 1], "twice": 2 * z[:, 0], "y": np.where(rng.random(n) < 0.1, np.nan, y), "flat": 3.0})
    df = spark.createDataFrame(data).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    # a covariate that another one makes useless changes nothing but a degree of freedom
    for covariates in (["u", "v"], ["u"], ["u", "twice"]):
        got = {r.feature: r for r in S.site_screen(df, ["y", "flat"], covariates).collect()}
        m = data["y"].notna()
        base = np.column_stack([np.ones(m.sum()), data.loc[m, covariates] - 1e4])
        full = np.column_stack([base, *[(data.loc[m, "site"] == f"s{k}") for k in range(1, 4)]]).astype(float)
        t = data.loc[m, "y"].to_numpy()
        rss = [((t - a @ np.linalg.lstsq(a, t, rcond=None)[0]) ** 2).sum() for a in (base, full)]
        d2 = m.sum() - full.shape[1]
        want = ((rss[0] - rss[1]) / 3) / (rss[1] / d2)
        assert (got["y"].n, got["y"].f, got["y"].delta_r2) == (m.sum(), pytest.approx(want, rel=1e-6), pytest.approx((rss[0] - rss[1]) / ((t - t.mean()) ** 2).sum(), rel=1e-6))
        assert got["y"].p == pytest.approx(K.f_survival(want, 3, int(d2)), rel=1e-5) and got["flat"].f is None


# elastic nets over a grid


def test_paths_equal_cold_starts():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 15)) @ rng.normal(size=(15, 15))
    y = x[:, :4] @ [1, -2, 0.5, 3] + rng.normal(size=200)
    x, y = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
    a, b = x.T @ x / 200, x.T @ y / 200
    alphas, ratios = [2.0, 0.5, 0.1, 0.02, 0.01], [0.0, 0.3, 1.0]
    path = P.net_path(a, b, alphas, ratios)
    for (alpha, ratio), w in path.items():
        cold = P.descend_active(a, b, np.zeros(15), np.arange(15), alpha * ratio, alpha * (1 - ratio), rounds=200_000, tol=1e-15)
        assert np.abs(w - cold).max() < 1e-9
        slope = b - a @ w - alpha * (1 - ratio) * w
        assert (np.abs(slope[w == 0]) <= alpha * ratio + 1e-9).all() and np.abs(slope[w != 0] - alpha * ratio * np.sign(w[w != 0])).max(initial=0) < 1e-9
    assert len(path) == 15 and (path[2.0, 1.0] == 0).all()


def test_grid_equals_a_loop_over_folds(spark, sf):
    rows = X.pair_visits(spark, sf)
    two = ["f_click", "f_view"]
    grid = P.repeated_grid(rows, two, "mfars_total", alphas=(0.01, 0.5), l1_ratios=(0.2,), folds=3, repeats=2)
    data = P.complete_rows(rows, two, "mfars_total").withColumn("r0", C.hash_fold(F.col("subject"), 3, 42)).withColumn("r1", C.hash_fold(F.col("subject"), 3, 43)).toPandas()
    got = {(r.repeat, r.fold, r.alpha): r for r in grid.fits.collect()}
    total = 0.0
    for r in (0, 1):
        for o in range(3):
            t, h = data[data[f"r{r}"] != o], data[data[f"r{r}"] == o]
            if not len(h):
                continue
            errors = {}
            for alpha in (0.01, 0.5):
                x, y = t[two].to_numpy(), t["mfars_total"].to_numpy()
                zx, zy = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
                w = K.descend(zx.T @ zx / len(x), zx.T @ zy / len(x), alpha, 0.2, tol=1e-14)
                p = y.mean() + y.std() * (((h[two].to_numpy() - x.mean(axis=0)) / x.std(axis=0)) @ w)
                errors[alpha] = ((h["mfars_total"].to_numpy() - p) ** 2).sum()
                assert got[r, o, alpha].coefs == pytest.approx(w, abs=1e-9) and (got[r, o, alpha].n, got[r, o, alpha].sse) == (len(h), pytest.approx(errors[alpha], rel=1e-6))
            total += min(errors.values())
    one = P.grid_summary(rows, two, "mfars_total", grid).first()
    assert one.rmse == pytest.approx(math.sqrt(total / (2 * len(data)))) and one.r2 == pytest.approx(1 - total / (2 * len(data) * data["mfars_total"].var(ddof=0)))
    assert P.repeated_grid(rows.where("false"), two, "mfars_total").fits.count() == 0
    assert P.net_bootstrap(rows.where("false"), two, "mfars_total").count() == 0


# networks


FUSED = N.Network(((0, 1), (2,), ()), hidden=(3, 2, 2), out=(2, 3, 1), relu_out=True, head=3, dropout=0.4, clinical=(("fars", 3, 0.3), ("sara", 4, 0.7)))


def test_joint_gradient_equals_differences():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(30, 5)) + 0.3
    ids = np.arange(30) * 7919
    for net in (FUSED, N.Network(((0, 1, 2),), dropout=0.3, clinical=(("fars", 3, 0.5),)), N.Network(((0,), (1, 2)), relu_out=True, head=2)):
        # biases of 0 would put units without input on the kink
        p = {k: x + 0.05 * rng.normal(size=x.shape) for k, x in N.start(net).items()}
        drop = (N.masks(net, ids, 1, 5), N.masks(net, ids, 2, 5))
        columns = [c for _, c, _ in net.clinical]
        targets = (a[:, columns], b[:, columns]) if columns else None

        def value():
            s = N.change_sums(net, p, a, b, drop, targets)
            return N._value(s["d"])[0] + N._error(s)

        parts = [N.change_sums(net, p, a[k : k + 10], b[k : k + 10], tuple({n: m[k : k + 10] for n, m in d.items()} for d in drop), targets and tuple(t[k : k + 10] for t in targets)) for k in (0, 10, 20)]
        g = N.whole_gradient(p, {k: sum(x[k] for x in parts) for k in parts[0]})
        for name, x in p.items():
            flat = x.reshape(-1)
            for j in range(len(flat)):
                old = flat[j]
                flat[j] = old + 1e-6
                up = value()
                flat[j] = old - 1e-6
                down = value()
                flat[j] = old
                assert g[name].reshape(-1)[j] == pytest.approx((up - down) / 2e-6, abs=1e-5), (net.head, name, j)


def test_dropout_is_a_function_of_the_row(spark, sf):
    ids = np.arange(4000)
    m = N.masks(FUSED, ids, 1, 3)
    assert {k: v.shape[1] for k, v in m.items()} == {"r0": 3, "r1": 2, "o0": 2, "o1": 3, "t": 3}
    assert all(set(np.unique(v)) == {0.0, 1 / 0.6} and abs((v == 0).mean() - 0.4) < 0.02 for v in m.values())
    some = np.array([17, 3999, 5])
    assert all((N.masks(FUSED, some, 1, 3)[k] == v[some]).all() for k, v in m.items())
    assert any((N.masks(FUSED, ids, 1, 4)[k] != v).any() for k, v in m.items()) and any((N.masks(FUSED, ids, 2, 3)[k] != v).any() for k, v in m.items())
    # the same weights at one partition and at eight
    rows = C.prepare(X.pair_visits(spark, sf), C.Plan("srm", ("f_click", "f_error", "f_view", "mfars_total", "sara_total")))
    net = N.Network(((0, 1), (2,)), relu_out=True, head=2, dropout=0.3, epochs=3, clinical=(("fars", 3, 1e-5), ("sara", 4, 1e-3)))
    one, eight = (N.fit_network(rows.repartition(k), net, train_clinical=True).p for k in (1, 8))
    assert all(one[k] == pytest.approx(eight[k], abs=1e-9) for k in one)
    with pytest.raises(ValueError, match="train_clinical"):
        N.fit_network(rows, net)


def test_heads_without_weight_change_nothing(spark, sf):
    rows = C.prepare(X.pair_visits(spark, sf), C.Plan("srm", ("f_click", "f_error", "f_view", "mfars_total")))
    plain = N.Network(((0, 1), (2,)), epochs=3)
    heads = N.Network(((0, 1), (2,)), epochs=3, clinical=(("fars", 3, 0.0),))
    a, b = N.fit_network(rows, plain), N.fit_network(rows, heads)
    assert all(a.p[k] == pytest.approx(b.p[k], abs=1e-12) for k in a.p) and set(b.p) - set(a.p) == {"u_fars", "v_fars"}


def test_contributions_add_up_and_linear_ones_are_exact(spark):
    rng = np.random.default_rng(8)
    x, back = rng.normal(size=(50, 5)), rng.normal(size=(20, 5))
    for net in (FUSED, N.Network(((0, 1), (1, 2, 4))), N.Network(((0, 1), ()), relu_out=True)):
        p = N.start(net)
        shap, base = N.attributions(net, p, x, back)
        assert shap.sum(axis=1) + base == pytest.approx(N.forward(net, p, x)[0], abs=1e-9)
        unused = set(range(5)) - {c for b in net.branches for c in b}
        assert not shap[:, list(unused)].any()
    net = N.Network(((0, 1),), hidden=2, out=1)
    # units that never rest are linear
    p = {"a0": np.array([[2.0, 0.0], [0.0, -1.0]]), "b0": np.full(2, 1e3), "c0": np.ones((2, 1)), "d0": np.zeros(1), "w0": np.ones(1)}
    df = spark.createDataFrame(pd.DataFrame({"k": range(50), "u": x[:, 0], "v": x[:, 1]})).unionByName(spark.createDataFrame([(99, None, 1.0)], "k long, u double, v double"))
    got = {(r.k, r.feature): (r.shap, r.base, r.score) for r in N.deep_shap(df, net, N.Fitted(p, np.zeros(2), np.ones(2)), ["u", "v"], ["k"], df).collect()}
    want = {(r.k, r.feature): r.shap for r in I.linear_shap(df.where("u is not null"), {"u": 2.0, "v": -1.0}, ["k"]).collect()}
    assert len(got) == 100 and all(v[0] == pytest.approx(want[k], abs=1e-9) for k, v in got.items())
    assert all(got[k, "u"][0] + got[k, "v"][0] + got[k, "u"][1] == pytest.approx(got[k, "u"][2], abs=1e-9) for k in range(50))
    by = {r.modality: r.mean_abs_shap for r in N.modality_shap(N.deep_shap(df, net, N.Fitted(p, np.zeros(2), np.ones(2)), ["u", "v"], ["k"], df), {"m": ["u"], "n": ["v"], "none": []}).collect()}
    assert by["none"] == 0 and by["m"] == pytest.approx(np.mean([abs(want[k, "u"]) for k in range(50)]))
