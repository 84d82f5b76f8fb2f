"""Evaluation metrics as aggregates.

Curves and rank metrics never sort all rows in one partition. Scores are first collapsed to
(group, score) counts (partial aggregation), then cumulative counts in descending score order come
from ``ranks.running_sums``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import PIECE, running_sums


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 when b == 0 (the zero_division=0 convention)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(df: DataFrame, group: Sequence[str], score: str, label: str, threshold) -> DataFrame:
    """One-pass counts and the derived rates at ``score >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    agg = df.groupBy(*group).agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = _div0(tp, tp + fp)
    recall = _div0(tp, tp + fn)
    return agg.select(
        *group, "tp", "fp", "tn", "fn",
        (_div0(tp + tn, tp + fp + tn + fn)).alias("accuracy"),
        (precision).alias("precision"), (recall).alias("recall"),
        (_div0(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        (tn / (tn + fp + F.lit(1e-9))).alias("specificity"))


def class_report(df: DataFrame, group: Sequence[str], pred: str, label: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages.

    One aggregate counts both classes; a Generate turns each group's row into its four lines."""
    aggs = []
    for cls in (0, 1):
        p, y = F.col(pred) == cls, F.col(label) == cls
        aggs += [F.count_if(p & y).alias(f"_tp{cls}"), F.count_if(p).alias(f"_np{cls}"), F.count_if(y).alias(f"_n{cls}")]
    one = df.groupBy(*group).agg(*aggs)
    lines, names = [], ("precision", "recall", "f1")
    for cls in (0, 1):
        tp, npred, n = (F.col(f"_{k}{cls}") for k in ("tp", "np", "n"))
        prec, rec = _div0(tp, npred), _div0(tp, n)
        lines.append(dict(zip(names, (prec, rec, _div0(2 * prec * rec, prec + rec)), strict=True), support=n))
    n0, n1 = lines[0]["support"], lines[1]["support"]
    macro = {k: (lines[0][k] + lines[1][k]) / 2 for k in names} | {"support": n0 + n1}
    weighted = {k: (lines[0][k] * n0 + lines[1][k] * n1) / (n0 + n1) for k in names} | {"support": n0 + n1}
    rows = [F.struct(F.lit(name).alias("class"), *[line[k].cast("double").alias(k) for k in names],
                     line["support"].cast("bigint").alias("support"))
            for name, line in (("0", lines[0]), ("1", lines[1]), ("macro avg", macro), ("weighted avg", weighted))]
    return one.select(*group, F.inline(F.array(*rows)))


def score_counts(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, score) -> positives, negatives: the only pass over the scored rows."""
    return df.groupBy(*group, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def cumulative_desc(counts: DataFrame, group: Sequence[str], score: str, piece: int = PIECE) -> DataFrame:
    """Add cp/cn = positives/negatives with score >= this score, and P/N totals per group."""
    done = running_sums(counts, group, [F.col(score).desc()], {"cp": F.col("pos"), "cn": F.col("neg")}, {"P": "cp", "N": "cn"}, piece)
    return done.select(*group, score, "pos", "neg", "cp", "cn", "P", "N")


def curve_points(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Per distinct score: cumulative TP/FP at threshold = score, with precision and recall."""
    return points_of_counts(score_counts(df, group, score, label), group, score)


def points_of_counts(counts: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """``curve_points`` from ``score_counts``."""
    c = cumulative_desc(counts, group, score)
    return c.select(*group, F.col(score).alias("threshold"), "pos", "neg", "cp", "cn", "P", "N",
                    _div0(F.col("cp"), F.col("cp") + F.col("cn")).alias("precision"),
                    _div0(F.col("cp"), F.col("P")).alias("recall"))


def roc_auc(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact AUC with ties counted one half."""
    c = cumulative_desc(score_counts(df, group, score, label), group, score)
    term = F.col("pos") * (F.col("N") - F.col("cn") + 0.5 * F.col("neg"))
    return c.groupBy(*group).agg((F.try_divide(F.sum(term), F.max("P") * F.max("N"))).alias("auc"))


def average_precision(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Step-wise AP = sum over thresholds of (recall gain) x precision."""
    c = cumulative_desc(score_counts(df, group, score, label), group, score)
    term = F.try_divide(F.col("pos"), F.col("P")) * (F.col("cp") / (F.col("cp") + F.col("cn")))
    return c.groupBy(*group).agg((F.sum(term)).alias("average_precision"))


def pr_curve(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """precision/recall at every distinct score threshold."""
    p = curve_points(df, group, score, label)
    return p.select(*group, "threshold", F.col("cp").alias("tp"), F.col("cn").alias("fp"),
                    (F.col("precision")).alias("precision"), (F.col("recall")).alias("recall"))


def roc_curve(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """TPR/FPR at every distinct score threshold."""
    p = curve_points(df, group, score, label)
    return p.select(*group, "threshold", (_div0(F.col("cp"), F.col("P"))).alias("tpr"),
                    (_div0(F.col("cn"), F.col("N"))).alias("fpr"))


def label_profile(df: DataFrame, group: Sequence[str], label: str, key: str) -> DataFrame:
    """Rows, positive rate, distinct learners, class counts per group."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.avg(F.col(label).cast("double"))).alias("positive_rate"),
        F.count_distinct(key).alias("n_learners"),
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) != 1).alias("n_neg"))
