"""Exact quantiles without one task that holds every value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the sketch is at most rows / SKETCH; brackets are four times as wide to each side.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, column: str, quantiles: Sequence[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., q, cut): quantiles of a column, linear between neighbours; nulls are left out, no values give no row.

    A mergeable sketch brackets each quantile between two values. Then the values below a bracket are only counted, and
    those inside, under a thousandth of the rows and their ties counted together, are ranked. Brackets, one for each
    group and quantile, are sent to all tasks, so groups are to be few (folds, cells). A bracket that misses its
    quantile, which the sketch's bound excludes, is an error.
    """
    qs = [float(q) for q in quantiles]
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter("_x is not null")
    ends = [e for q in qs for e in (max(q - 4 / SKETCH, 0.0), min(q + 4 / SKETCH, 1.0))]
    sketch = rows.groupBy(*by).agg(F.percentile_approx("_x", ends, SKETCH).alias("_e"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count("*").alias("_n")).filter("_n > 0")
    whole = F.col("_n") < 2 * SKETCH  # few rows: a bracket would be narrower than two neighbours

    def end(i: int, edge: str, outermost: float):
        return F.when(whole | F.lit(ends[i] == outermost), F.col(edge)).otherwise(F.get("_e", F.lit(i)))

    spans = [F.struct(F.lit(q).alias("q"), end(2 * i, "_min", 0).alias("lo"), end(2 * i + 1, "_max", 1).alias("hi")) for i, q in enumerate(qs)]
    spans = sketch.select(*by, "_n", F.inline(F.array(*spans)))
    keys = [*by, "q"]
    near = rows.join(F.broadcast(spans), list(by)) if by else rows.join(F.broadcast(spans))
    place = F.when(F.col("_x") >= F.col("lo"), F.col("_x"))  # null: below the bracket
    held = near.filter(F.col("_x") <= F.col("hi")).groupBy(*keys, "_n", place.alias("_v")).agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_end", F.sum("_m").over(upto)).withColumn("_at", F.col("q") * (F.col("_n") - 1))

    def ranked(rank):
        """The value with this rank from 0."""
        return F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_m") <= rank), F.col("_v")))

    low, high = F.floor("_at"), F.ceil("_at")
    found = held.groupBy(*keys).agg(ranked(low).alias("_a"), ranked(high).alias("_b"), F.first(F.col("_at") - low).alias("_part"))
    cut = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a sketch missed its quantile")).cast("double")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b"))
    return found.select(*by, "q", cut.alias("cut"))
