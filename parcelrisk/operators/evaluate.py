"""Score evaluation: ROC points, AUC (trapezoid or right rectangle), curve
summaries, log loss and the MLlib evaluator.

All curve work starts from one aggregate by distinct score (positives and
negatives per score), so ties are handled exactly and a hot score value is a
single row.  Running sums in descending score use ``prefix_sums``: no single
partition ever holds the curve.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelrisk.operators.ranking import prefix_sums


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct non-null score."""
    y = F.col(label).cast("int")
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s) & y.isNotNull()) \
        .groupBy(s.alias("threshold")) \
        .agg(F.sum(y).cast("bigint").alias("pos"),
             F.sum(F.lit(1) - y).cast("bigint").alias("neg"))


def curve_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, descending: own counts, cumulative counts (``tps``,
    ``fps``), class totals (``P``, ``N``) and the counts of the next score."""
    c = prefix_sums(score_counts(df, score, label), "threshold", ["pos", "neg"],
                    descending=True, next_of=["pos", "neg"])
    return c.select("threshold", "pos", "neg",
                    F.col("_cum_pos").alias("tps"), F.col("_cum_neg").alias("fps"),
                    F.col("_tot_pos").alias("P"), F.col("_tot_neg").alias("N"),
                    "_next_pos", "_next_neg")


def roc_points(df: DataFrame, score: str, label: str,
               drop_intermediate: bool = False) -> DataFrame:
    """ROC curve: one point per distinct score (threshold, tps, fps, tpr,
    fpr) plus the start point (threshold null, 0, 0).  With
    ``drop_intermediate`` a point whose step equals the next step (collinear
    with both neighbours) is dropped, as scikit-learn does."""
    c = curve_table(df, score, label)
    pts = c.select("threshold", F.col("tps").cast("bigint").alias("tps"),
                   F.col("fps").cast("bigint").alias("fps"),
                   (F.col("tps") / F.col("P")).alias("tpr"),
                   (F.col("fps") / F.col("N")).alias("fpr"),
                   "pos", "neg", "_next_pos", "_next_neg")
    if drop_intermediate:
        pts = _drop_collinear(pts)
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tps"),
        F.lit(0).cast("bigint").alias("fps"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(pts.drop("pos", "neg", "_next_pos", "_next_neg"))


def _keep_flags(pts: DataFrame) -> DataFrame:
    """Add ``_keep`` = 1 for the points scikit-learn keeps with
    ``drop_intermediate``: the first and the last point, and every point
    whose step (pos, neg) differs from the next point's step."""
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    keep = first | F.col("_next_pos").isNull() | (F.col("_next_pos") != F.col("pos")) \
        | (F.col("_next_neg") != F.col("neg"))
    return pts.withColumn("_keep", keep.cast("int"))


def _drop_collinear(pts: DataFrame) -> DataFrame:
    return _keep_flags(pts).where(F.col("_keep") == 1).drop("_keep")


def auc(df: DataFrame, score: str, label: str, rule: str = "trapezoid",
        drop_intermediate: bool = False) -> DataFrame:
    """Area under the ROC curve, one row ``auc``.

    trapezoid: sum over thresholds of neg_i * (2 tps_i - pos_i) / (2 P N);
    right rectangle (``sum(diff(fpr) * tpr[1:])``): sum neg_i * tps_i / (P N).
    The sums are exact integers (decimal(38,0)), divided once.

    ``drop_intermediate`` evaluates the rule on the reduced curve (collinear
    points dropped, as scikit-learn's default ``roc_curve`` returns it).
    The trapezoid is the same either way; the right rectangle is not: each
    kept point then spans the whole run of equal steps before it.
    """
    c = curve_table(df, score, label)
    d = lambda e: e.cast("decimal(38,0)")
    if drop_intermediate and rule == "right":
        return _auc_right_reduced(c)
    if rule == "trapezoid":
        term, scale = d(F.col("neg")) * d(F.lit(2) * F.col("tps") - F.col("pos")), 2.0
    elif rule == "right":
        term, scale = d(F.col("neg")) * d(F.col("tps")), 1.0
    else:
        raise ValueError("rule must be 'trapezoid' or 'right'")
    return c.agg(F.sum(term).alias("_s"), F.max("P").alias("_P"), F.max("N").alias("_N")) \
        .select((F.col("_s").cast("double") / (F.lit(scale) * F.col("_P").cast("double")
                                               * F.col("_N").cast("double"))).alias("auc"))


def _auc_right_reduced(c: DataFrame) -> DataFrame:
    """Right-rectangle area over the kept points.  A running count of kept
    points (distributed, ``prefix_sums``) numbers the segments: a kept point
    closes its segment, a dropped one belongs to the next kept point.  Per
    segment: negatives added and the closing point's tps."""
    flagged = _keep_flags(c)
    cum = prefix_sums(flagged, "threshold", ["_keep"], descending=True)
    seg = F.when(F.col("_keep") == 1, F.col("_cum__keep")).otherwise(F.col("_cum__keep") + 1)
    per = cum.groupBy(seg.alias("_seg")).agg(
        F.sum("neg").alias("dneg"), F.max("tps").alias("tps"),
        F.max("P").alias("P"), F.max("N").alias("N"))
    d = lambda e: e.cast("decimal(38,0)")
    return per.agg(F.sum(d(F.col("dneg")) * d(F.col("tps"))).alias("_s"),
                   F.max("P").alias("_P"), F.max("N").alias("_N")) \
        .select((F.col("_s").cast("double") / (F.lit(1.0) * F.col("_P").cast("double")
                                               * F.col("_N").cast("double"))).alias("auc"))


def curve_summary(points: DataFrame) -> DataFrame:
    """Mean TPR over all curve points, and mean of TPR x threshold with the
    start point contributing 0 (its threshold is above every score)."""
    return points.agg(
        F.avg("tpr").alias("mean_tpr"),
        (F.sum(F.coalesce(F.col("tpr") * F.col("threshold"), F.lit(0.0))) /
         F.count(F.lit(1))).alias("mean_tpr_x_threshold"),
        F.count(F.lit(1)).alias("n_points"))


def log_loss(df: DataFrame, score: str, label: str, eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with the probability clipped to [eps, 1 - eps],
    over the rows with a label and a score that is a number (not null, NaN or
    infinite)."""
    x = F.col(score).cast("double")
    df = df.where((F.abs(x) < F.lit(float("inf"))) & F.col(label).isNotNull())
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg(F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("log_loss"))


def auc_roc(df: DataFrame, score: str, label: str) -> float:
    """MLlib evaluator on a score column (the exact curve: numBins=0)."""
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label,
                                       metricName="areaUnderROC", numBins=0)
    return ev.evaluate(df.select(F.col(score).cast("double").alias(score),
                                 F.col(label).cast("double").alias(label)))
