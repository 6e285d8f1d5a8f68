"""Kernels and cross-validation against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import cv as C
from tideline.operators import kernels as K
from tideline.operators import moments as M
from tideline.plans import fixtures as X

FOUR = ("f_click", "f_error", "f_purchase", "f_view")


def test_incomplete_beta():
    assert K.beta_inc(2, 3, 0.5) == pytest.approx(0.6875)
    assert K.beta_inc(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert K.beta_inc(5, 0.5, 10 / (10 + 2.228138852**2)) == pytest.approx(0.05, abs=1e-6)  # t of 10 degrees of freedom
    assert K.f_survival(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_weights_equal_numpy():
    rng = np.random.default_rng(0)
    d = rng.normal(0.3, 1, (200, 4)) @ rng.normal(size=(4, 4))
    g = M.square(M.gram(d))
    want = np.linalg.solve(np.cov(d, rowvar=False) + 1e-6 * np.eye(4), d.mean(axis=0))
    assert np.allclose(K.srm_weights(g), want)
    a, b = d[:100], d[100:]
    pooled = 0.5 * (np.cov(a, rowvar=False) + np.cov(b, rowvar=False))
    ridge = 1e-3 * np.trace(pooled) / 4
    assert np.allclose(K.lda_weights(M.square(M.gram(a)), M.square(M.gram(b))), np.linalg.solve(pooled + ridge * np.eye(4), b.mean(axis=0) - a.mean(axis=0)))
    assert (K.srm_weights(M.square(M.gram(d[:1]))) == 0).all()
    assert K.lda_weights(M.square(M.gram(a[:1])), M.square(M.gram(b))) is None


def test_elastic_net_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 5))
    y = x @ np.array([2, 0, -1, 0, 0.2]) + rng.normal(size=150) + 3
    alpha, l1 = 0.3, 0.7
    w, b = K.elastic_net(M.square(M.gram(np.column_stack([x, y]))), alpha, l1)
    slope = x.T @ (y - b - x @ w) / 150 - x.mean(axis=0) * (y - b - x @ w).mean() - alpha * (1 - l1) * w
    assert np.all(np.abs(slope[w == 0]) <= alpha * l1 + 1e-6)
    assert np.allclose(slope[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-6)
    assert b == pytest.approx(y.mean() - x.mean(axis=0) @ w)


def test_message_length_equals_direct():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 2)), rng.normal(size=80)
    z = np.column_stack([np.ones(80), x])
    rest = y - z @ np.linalg.solve(z.T @ z + 1e-6 * np.eye(3), z.T @ y)
    v = rest @ rest / 80
    want = 1.5 * np.log(80 / 12) + 0.5 * (np.linalg.slogdet(z.T @ z)[1] - 3 * np.log(v)) + 40 * np.log(2 * np.pi * v) + 40
    assert K.message_length(M.square(M.gram(np.column_stack([x, y]))), [0, 1]) == pytest.approx(want, rel=1e-9)


def test_gram_matrix_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 1.0), ("b", 3.0, 4.0), ("a", 5.0, 7.0)], "k string, x double, y double").repartition(3)
    g = M.gram_matrix(df, ["x", "y"], "k")
    assert np.allclose(g["a"], M.square(M.gram(np.array([[1.0, 2.0], [5.0, 7.0]]))))
    assert g["b"][0, 0] == 1


@pytest.mark.parametrize("kind", ["srm", "lda"])
def test_cv_equals_a_serial_loop(spark, sf, kind):
    sf = sf.replace("0.001", "0.01")
    long = X.pair_visits(spark, sf)
    plan = C.Plan(kind, FOUR, candidates=(C.Candidate(clip=2.0),))
    oof = {(r.pair_id, r.visit): r.score for r in C.cross_validate(long, plan)[0].collect()}
    rows = C.prepare(long, plan).collect()
    a, b = np.array([r.a for r in rows]), np.array([r.b for r in rows])
    fold = np.array([r.outer[0] for r in rows])
    seen = 0
    for o in range(5):
        t = fold != o
        both = np.concatenate([a[t], b[t]])
        mu, sd = both.mean(axis=0), both.std(axis=0)
        za, zb = np.clip((a - mu) / sd, -2, 2), np.clip((b - mu) / sd, -2, 2)
        d = (zb - za)[t]
        if kind == "srm":
            w = np.linalg.solve(np.cov(d, rowvar=False) + 1e-6 * np.eye(4), d.mean(axis=0))
        else:
            pooled = 0.5 * (np.cov(za[t], rowvar=False) + np.cov(zb[t], rowvar=False))
            w = np.linalg.solve(pooled + 1e-3 * np.trace(pooled) / 4 * np.eye(4), zb[t].mean(axis=0) - za[t].mean(axis=0))
            w = -w if w @ d.mean(axis=0) < 0 else w
        for k in np.flatnonzero(~t):
            assert oof[rows[k].pair_id, 1] == pytest.approx(za[k] @ w)
            assert oof[rows[k].pair_id, 2] == pytest.approx(zb[k] @ w)
            seen += 2
    assert seen == len(oof)
    subjects = {}
    for r in rows:
        subjects.setdefault(r.subject, set()).add(r.outer[0])
    assert all(len(f) == 1 for f in subjects.values())


def test_nested_cv_chooses_one_candidate_a_fold(spark, sf):
    long = X.pair_visits(spark, sf.replace("0.001", "0.01"))
    table = C.cross_validate(long, C.Plan("srm", FOUR, candidates=C.grid(shrinkage=(0.0, 1.0), clip=(None, 2.0)))).candidates
    rows = table.collect()
    assert len(rows) == 20
    assert sorted(r.outer for r in rows if r.chosen) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("method", C.SELECTIONS[1:])
def test_selection_inside_folds_equals_a_serial_loop(spark, sf, method):
    long = X.pair_visits(spark, sf.replace("0.001", "0.01"))
    names = [*X.FEATURES, "sara_total"]
    plan = C.Plan("srm", tuple(names), selection=method, k=3, sparse=(0.2, 0.5, 1e-3))
    found = C.cross_validate(long, plan)
    got = {r.fold: r.features for r in found.selected.collect()}
    rows = C.prepare(long, plan).collect()
    a, b = np.array([r.a for r in rows]), np.array([r.b for r in rows])
    fold, interval = np.array([r.outer[0] for r in rows]), np.array([r.interval for r in rows])
    scores = {(r.pair_id, r.visit): r.score for r in found.scores.collect()}
    for o in range(5):
        t = fold != o
        d = (b - a)[t]
        each = np.array([[x.mean() / x.std(ddof=1) for x in d[interval[t] == k].T] for k in (1, 2)])
        both, gap = each.mean(axis=0), np.abs(each[0] - each[1])
        if method == "progression_univariate":
            want = sorted(names, key=lambda f: (-abs(both[names.index(f)]), gap[names.index(f)], f))[:3]
        elif method == "progression_mrmr":
            want = K.mrmr(both, np.corrcoef(d, rowvar=False), names, 3, 0.25)
        elif method == "sparse_srm":
            w = K.sparse_srm([M.square(M.gram(d[interval[t] == k])) for k in (1, 2)], 0.2, 0.5)
            want = [f for f in sorted(names, key=lambda f: (-abs(w[names.index(f)]), f)) if abs(w[names.index(f)]) > 1e-3][:3]
        elif method == "mml":
            y = np.repeat([0.0, 1.0], t.sum())
            want = [f for f, _ in K.mml_forward(M.square(M.gram(np.column_stack([np.concatenate([a[t], b[t]]), y]))), names)][:3]
        else:
            x, y = np.concatenate([a[t], b[t]]), np.repeat([0, 1], t.sum())
            value = []
            for c in x.T:
                edges = sorted(set(np.quantile(c, np.arange(1, C.BINS) / C.BINS)))
                bins = np.array([sum(e < v for e in edges) for v in c])
                joint = np.array([[((bins == i) & (y == j)).mean() for j in (0, 1)] for i in range(len(edges) + 1)])
                alone = joint.sum(axis=1)[:, None] * joint.sum(axis=0)
                value.append((joint[joint > 0] * np.log(joint[joint > 0] / alone[joint > 0])).sum())
            want = sorted(names, key=lambda f: (-value[names.index(f)], f))[:3]
        assert got[o] == want
        at = [names.index(f) for f in want]
        x = np.concatenate([a[t], b[t]])[:, at]
        za, zb = (a[:, at] - x.mean(axis=0)) / x.std(axis=0), (b[:, at] - x.mean(axis=0)) / x.std(axis=0)
        dz = (zb - za)[t]
        w = np.linalg.solve(np.cov(dz, rowvar=False).reshape(len(at), len(at)) + 1e-6 * np.eye(len(at)), dz.mean(axis=0)) if at else np.zeros(0)
        for k in np.flatnonzero(~t):
            assert scores[rows[k].pair_id, 2] == pytest.approx(zb[k] @ w, abs=1e-9)


def test_large_means_keep_their_digits(spark, sf):
    from tideline.operators.preprocess import zscore_by_fold

    long = X.pair_visits(spark, sf.replace("0.001", "0.01"))
    far = long.withColumns({f: F.col(f) + 1e9 for f in FOUR})
    one, two = ({(r.pair_id, r.visit): r.score for r in C.cross_validate(x, C.Plan("srm", FOUR)).scores.collect()} for x in (long, far))
    assert all(two[k] == pytest.approx(v, abs=1e-3) for k, v in one.items())
    v = long.select("pair_id", "visit", "f_view", (F.col("visit") % 2).alias("fold")).dropna()
    one, two = (sorted((r.outer, r.pair_id, r.visit, r.f_view) for r in zscore_by_fold(x, ["f_view"]).collect()) for x in (v, v.withColumn("f_view", F.col("f_view") + 1e9)))
    assert all(x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-4) for x, y in zip(one, two))


def test_subgroup_importance_equals_refits(spark, sf):
    from tideline.operators import importance as I
    from tideline.operators.resample import hash_number

    long = X.pair_visits(spark, sf.replace("0.001", "0.01"))
    x, z, profiles = ("f_click", "f_view"), ("adl_total", "mfars_total"), {"low": {"adl_total": 4.0, "mfars_total": 900.0}, "high": {"adl_total": 30.0, "mfars_total": 100.0}}
    got = {(r.feature, r.subgroup): r for r in I.subgroup_importance(long, x, z, profiles, 0.05, 0.1, replicates=4).collect()}
    rows = C.prepare(long, C.Plan("interaction", x, z)).withColumn("h", hash_number(F.concat_ws("|", F.lit("42"), "subject"))).collect()
    a, b = np.array([r.a for r in rows]), np.array([r.b for r in rows])
    beta = {k: [] for k in got}
    for r in range(4):
        times = I.draws(np.array([row.h for row in rows], dtype=np.uint64), r)
        aa, bb = np.repeat(a, times, axis=0), np.repeat(b, times, axis=0)
        both = np.concatenate([aa, bb])
        mu, sd = both.mean(axis=0), both.std(axis=0)
        wide = lambda v: np.column_stack([v[:, :2], v[:, :1] * v[:, 2:], v[:, 1:2] * v[:, 2:]])
        d = wide((bb - mu) / sd) - wide((aa - mu) / sd)
        w = K.constant_net(M.square(M.gram(d)), 0.05, 0.1)
        for name, profile in profiles.items():
            at = (np.array([profile[m] for m in z]) - mu[2:]) / sd[2:]
            for j, f in enumerate(x):
                beta[f, name].append(w[j] + w[2 + 2 * j : 4 + 2 * j] @ at)
    for k, v in beta.items():
        assert (got[k]["mean"], got[k].lo, got[k].hi) == (pytest.approx(np.mean(v), abs=1e-6), pytest.approx(np.percentile(v, 2.5), abs=1e-6), pytest.approx(np.percentile(v, 97.5), abs=1e-6))
        assert got[k].sign_consistency == pytest.approx(np.mean(np.sign(v) == np.sign(np.median(v))))


def test_logistic_model_meets_its_conditions(spark):
    from tideline.operators.audit import followup_model

    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (80, 2))
    y = rng.random(80) < 1 / (1 + np.exp(-(x[:, 0] - 3)))
    rows = [(f"s{k}", 1, float(u), float(v)) for k, (u, v) in enumerate(x)] + [(f"s{k}", 3, 0.0, 0.0) for k in np.flatnonzero(y)]
    df = spark.createDataFrame(rows, "subject_id string, visit int, u double, v double")
    fit = followup_model(df, ["u", "v"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.array([fit.weights["u"], fit.weights["v"]])
    p = 1 / (1 + np.exp(-(z @ w + fit.intercept)))
    assert np.allclose(z.T @ (p - y) + w, 0, atol=1e-6) and abs((p - y).sum()) < 1e-6
    assert fit.n == 80 and fit.accuracy == pytest.approx(((p > 0.5) == y).mean())
    assert followup_model(df.where("visit = 1"), ["u", "v"]) is None


def test_left_out_subjects_are_never_seen(spark):
    from tideline.operators import composite as O

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=40) + 1e6
    who = [f"s{k % 13}" for k in range(40)]
    df = spark.createDataFrame([(w, *map(float, r), float(t)) for w, r, t in zip(who, x, y)], "subject string, a double, b double, c double, y double")
    got = sorted((r.subject, r.target, r.prediction) for r in O.leave_one_subject_out(df, ["a", "b", "c"], "y", alphas=(0.2,), l1_ratios=(0.3,)).collect())
    want = []
    for s in set(who):
        t = np.array([w != s for w in who])
        zx, zy = (x[t] - x[t].mean(axis=0)) / x[t].std(axis=0), (y[t] - y[t].mean()) / y[t].std()
        w = K.descend(zx.T @ zx / t.sum(), zx.T @ zy / t.sum(), 0.2, 0.3)
        want += [(s, float(v), float(y[t].mean() + y[t].std() * ((r - x[t].mean(axis=0)) / x[t].std(axis=0)) @ w)) for r, v in zip(x[~t], y[~t])]
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(g[2] == pytest.approx(w[2], abs=1e-6) for g, w in zip(got, sorted(want)))
    found = O.leave_one_subject_out(df, ["a", "b", "c"], "y", alphas=O.ALPHAS, l1_ratios=O.L1_RATIOS, scale_target=False)
    row = O.search_summary(found).first()
    assert row.n_rows == 40 and row.rmse < 3 and row.alpha_mode in O.ALPHAS


def test_contributions_sum_to_the_score_change(spark, sf):
    from tideline.operators.importance import contributions
    from tideline.plans.queries_models import _deltas

    d = _deltas(spark, sf).select("interval", "f_view", "f_click").dropna()
    w = {"f_view": 0.7, "f_click": -0.4}
    parts = contributions(d, w).agg(F.sum("contribution_v1_v2")).first()[0]
    whole = d.where("interval = 'V1->V2'").agg(F.avg(0.7 * F.col("f_view") - 0.4 * F.col("f_click"))).first()[0]
    assert parts == pytest.approx(whole)


def test_numpy_folds_are_disjoint_and_even():
    from tideline.operators.resample import numpy_folds

    folds = numpy_folds([f"s{k}" for k in range(13)] * 2, 5, 7)
    sizes = np.bincount(list(folds.values()))
    assert len(folds) == 13 and sizes.max() - sizes.min() <= 1


def test_network_gradient_and_antisymmetry():
    from tideline.operators import neural as N

    rng = np.random.default_rng(3)
    net = N.Network(((0, 1), (2,), ()), hidden=3, out=2)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    p = N.start(net)

    def value():
        return N.loss(N.forward(net, p, b)[0] - N.forward(net, p, a)[0])[0]

    (s1, k1), (s2, k2) = N.forward(net, p, a), N.forward(net, p, b)
    _, g = N.loss(s2 - s1)
    g1, g2 = N.backward(net, p, k1, -g), N.backward(net, p, k2, g)
    for k in p:
        flat = p[k].reshape(-1)
        old = flat[0]
        flat[0] = old + 1e-5
        up = value()
        flat[0] = old - 1e-5
        down = value()
        flat[0] = old
        assert (g1[k] + g2[k]).reshape(-1)[0] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)
    assert N.loss(np.array([1.0]))[0] == 0.0
    # sums over parts of the rows give the gradient of the whole
    parts = [N.change_sums(net, p, a[k : k + 7], b[k : k + 7]) for k in (0, 7, 14)]
    whole = N.whole_gradient(p, {k: sum(x[k] for x in parts) for k in parts[0]})
    assert all(np.allclose(whole[k], g1[k] + g2[k]) for k in p)


def test_networks_train_like_a_serial_loop(spark, sf):
    from tideline.operators import neural as N
    from tideline.operators.resample import hash_fold

    net = N.Network(((0, 1), (2,)), epochs=6, patience=2)
    plan = C.Plan("srm", ("f_click", "f_view", "f_error"))
    prepared = C.prepare(X.pair_visits(spark, sf.replace("0.001", "0.01")), plan)
    got = {(r.pair_id, r.visit): r.score for r in N.network_cv(prepared, net).collect()}
    rows = prepared.withColumn("v", hash_fold(F.col("subject"), 1000, net.seed) < 200).collect()
    a, b, fold, held = (np.array([x[i] for x in ((r.a, r.b, r.outer[0], r.v) for r in rows)]) for i in range(4))
    assert len(got) == 2 * len(rows)
    for o in range(5):
        t = fold != o
        both = np.concatenate([a[t], b[t]])
        za, zb = (a - both.mean(axis=0)) / both.std(axis=0), (b - both.mean(axis=0)) / both.std(axis=0)
        now = N.Training.of(net)
        for _ in range(net.epochs):
            (s1, k1), (s2, k2) = N.forward(net, now.p, za[t & ~held]), N.forward(net, now.p, zb[t & ~held])
            _, g = N.loss(s2 - s1)
            g1, g2 = N.backward(net, now.p, k1, -g), N.backward(net, now.p, k2, g)
            now.step(net, {k: g1[k] + g2[k] for k in now.p})
            if not now.judge(net, N.loss(N.forward(net, now.p, zb[t & held])[0] - N.forward(net, now.p, za[t & held])[0])[0]):
                break
        for k in np.flatnonzero(~t):
            assert got[rows[k].pair_id, 2] == pytest.approx(N.forward(net, now.best, zb[k : k + 1])[0][0], abs=1e-6)


def test_equal_visits_have_no_effect(spark, sf):
    from tideline.operators.moments import gram

    g = M.square(gram(np.zeros((5, 2))))
    assert np.allclose(K.srm_weights(g), 0)
