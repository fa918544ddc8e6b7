"""Classification metrics as exact aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(scored: DataFrame, by: tuple[str, ...] = (), label: str = "y", score: str = "score") -> DataFrame:
    """(by..., auc, n_pos, n_neg): share of positive-negative pairs in order, ties half; null with one class.

    Rows are counted by score first. The counts before each score go from one range of scores to the next, so no task
    holds all of them. Ranges are pairs of rising functions of the score, so they keep its order: its logarithm in
    steps of a 64th of an octave, which tells small scores apart, and its 4096ths, which tell those near one half.
    """
    pos = F.sum(F.col(label).cast("long"))
    each = scored.groupBy(*by, score).agg(pos.alias("_p"), (F.count("*") - pos).alias("_n"))
    size = F.floor(F.log2(F.abs(F.col(score))) * 64) + (1 << 17)  # doubles begin at 2 ** -1074
    log = F.when(F.col(score) == 0, F.lit(0)).otherwise(F.when(F.col(score) < 0, -size).otherwise(size))
    each = each.withColumn("_range", F.struct(log.cast("long").alias("log"), F.floor(F.col(score) * 4096).alias("step")))
    sums = each.groupBy(*by, "_range").agg(F.sum("_n").alias("_t"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_t").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    each = each.join(sums, [*by, "_range"])
    inside = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    each = each.withColumn("_won", F.col("_p") * (below + F.col("_n") / 2.0))
    total = each.groupBy(*by).agg(F.sum("_won").alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return total.select(*by, F.try_divide("_w", F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)).cast("double")).alias("auc"), "n_pos", "n_neg")


def binary_metrics(scored: DataFrame, threshold: Column | float = 0.5, by: tuple[str, ...] = (), label: str = "y", score: str = "score") -> DataFrame:
    """(by..., n, accuracy, precision, recall, f1, base_rate, majority_accuracy, n_positive, n_flagged): ratios without a
    denominator are 0. majority_accuracy is that of never saying yes."""
    y, hit = F.col(label) == 1, F.col(score) >= threshold

    def count(c: Column) -> Column:
        return F.sum(c.cast("long"))

    tp, fp, fn = count(y & hit), count(~y & hit), count(y & ~hit)
    zero = F.lit(0.0)
    rows = scored.groupBy(*by).agg(F.count("*").alias("n"), count(y == hit).alias("_right"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), count(y).alias("_pos"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    base = F.try_divide("_pos", "n")
    return rows.select(*by, "n", F.try_divide("_right", "n").alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), base.alias("base_rate"), (1 - base).alias("majority_accuracy"), F.col("_pos").alias("n_positive"), (F.col("tp") + F.col("fp")).alias("n_flagged"))


def model_metrics(scored: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = (), label: str = "y", score: str = "score") -> DataFrame:
    """binary_metrics with roc_auc, null where there is one class, and the confusion counts tp, fp, fn, tn."""
    from tickloom.functions.scan import beside

    hit, y = (F.col(score) >= threshold).cast("long"), F.col(label).cast("long")
    counts = scored.groupBy(*by).agg(F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"), F.sum((1 - hit) * (1 - y)).alias("tn"))
    area = auc(scored, by, label, score).select(*by, F.col("auc").alias("roc_auc"))
    rows = binary_metrics(scored, threshold, by, label, score)
    for other in (area, counts):
        rows = rows.join(other, list(by)) if by else beside(rows, other)
    return rows


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), label: str = "y", score: str = "score") -> DataFrame:
    """binary_metrics at each threshold, in one pass."""
    wide = scored.select(label, score, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return binary_metrics(wide, F.col("threshold"), ("threshold",), label, score)


def class_weight(scored: DataFrame, label: str = "y") -> float:
    """Negatives for each positive."""
    row = scored.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).first()
    if not row["p"]:
        raise ValueError("there is no positive row")
    return (row["n"] - row["p"]) / row["p"]


def block_bootstrap_auc(scored: DataFrame, n_boot: int = 400, block: int = 3900, seed: int = 7, label: str = "y", score: str = "score", key: str = "start") -> DataFrame:
    """(lo, hi, p_le_half, n_boot, block) of the AUC over contiguous blocks of rows drawn with replacement.

    The draws are numpy's on the driver, n // block starts a replicate; rows join the replicates whose blocks hold
    them. Replicates with one class are left out.
    """
    from tickloom.functions.scan import positions

    rows = positions(scored.select(key, label, score), key, out="pos")
    n = scored.count()
    if n <= block:
        raise ValueError(f"more than {block} rows are needed, not {n}")
    rng = np.random.default_rng(seed)
    picks = [(i, int(p)) for i in range(n_boot) for p in rng.integers(0, n - block, max(1, n // block))]
    starts = scored.sparkSession.createDataFrame(picks, "rep int, first long")
    spans = starts.select("rep", "first", F.explode(F.expr(f"sequence(first div {block}, (first + {block} - 1) div {block})")).alias("b"))
    held = rows.withColumn("b", F.expr(f"pos div {block}")).join(F.broadcast(spans), "b").filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + block))
    each = auc(held.select("rep", F.col(label).alias("y"), F.col(score).alias("score")), ("rep",)).filter("auc is not null")
    return each.agg(F.percentile("auc", 0.025).alias("lo"), F.percentile("auc", 0.975).alias("hi"), F.avg((F.col("auc") <= 0.5).cast("double")).alias("p_le_half"), F.count("*").alias("n_boot"), F.lit(block).alias("block"))
