import numpy as np

from parcelrisk.operators import evaluate


def fixture(spark):
    return spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")


def test_roc_points(spark):
    pts = evaluate.roc_points(fixture(spark), "s", "y").collect()
    got = sorted((r.fpr, r.tpr) for r in pts)
    assert got == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_auc_rules(spark):
    assert evaluate.auc(fixture(spark), "s", "y", "trapezoid").first().auc == 0.875
    assert evaluate.auc(fixture(spark), "s", "y", "right").first().auc == 1.0


def test_log_loss(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    assert abs(evaluate.log_loss(df, "p", "y").first().log_loss - 0.693147) < 1e-6


def test_trapezoid_auc_equals_mllib_and_roc_is_monotone(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 5000)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)   # tied scores
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    mine = evaluate.auc(df, "s", "y").first().auc
    assert abs(mine - evaluate.auc_roc(df, "s", "y")) < 1e-9
    pts = sorted((r.fps, r.tps) for r in evaluate.roc_points(df, "s", "y").collect())
    assert pts[0] == (0, 0) and pts[-1] == (int((y == 0).sum()), int(y.sum()))
    assert all(b[0] >= a[0] and b[1] >= a[1] for a, b in zip(pts, pts[1:]))


def test_drop_intermediate_keeps_corners(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 0)], "s double, y int")
    pts = sorted((r.fpr, r.tpr) for r in
                 evaluate.roc_points(df, "s", "y", drop_intermediate=True).collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def _sk_roc(y, s, drop=True):
    """scikit-learn's roc_curve, written out with numpy (brute force)."""
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps = fps[keep], tps[keep]
    tps, fps = np.r_[0, tps], np.r_[0, fps]
    return fps / fps[-1], tps / tps[-1]


def test_right_rectangle_on_reduced_curve_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    # long runs of single-class distinct scores: many collinear points
    s = np.round(rng.random(3000), 3)
    y = (s > 0.4).astype(int) ^ (rng.random(3000) < 0.1)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    for drop in (False, True):
        fpr, tpr = _sk_roc(y, s, drop)
        want = float((np.diff(fpr) * tpr[1:]).sum())
        got = evaluate.auc(df, "s", "y", "right", drop_intermediate=drop).first().auc
        assert abs(got - want) < 1e-12, (drop, got, want)
    fpr, tpr = _sk_roc(y, s, True)
    pts = evaluate.roc_points(df, "s", "y", drop_intermediate=True).collect()
    assert len(pts) == len(fpr)
    summ = evaluate.curve_summary(spark.createDataFrame(pts)).first()
    assert abs(summ.mean_tpr - tpr.mean()) < 1e-12
