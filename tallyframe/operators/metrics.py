"""Confusion counts, the metric family, threshold sweeps and class balance, all from one pass of sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.columns import binarize
from tallyframe.operators.quantiles import quantiles, same

COUNTS = ("tn", "fp", "fn", "tp")


def confusion(df: DataFrame, threshold: float = 0.5, op: str = ">=", keys: Sequence[str] = (), prob: str = "prob", label: str = "label") -> DataFrame:
    """tn, fp, fn, tp for each key; rows with a null label or probability count nowhere."""
    pred = binarize(F.col(prob), threshold, op)
    hit = lambda y, p: F.count_if((F.col(label) == y) & (pred == p))
    return df.groupBy(*keys).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _ratio(a: Column, b: Column, zero: float | None) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(zero).cast("double"))


def metric_columns(zero_division: float | None = 0.0) -> dict[str, Column]:
    """The metric family over columns tn, fp, fn, tp; ``zero_division`` (None: null) stands for empty denominators."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    n = tn + fp + fn + tp
    recall, specificity = _ratio(tp, tp + fn, zero_division), _ratio(tn, tn + fp, zero_division)
    return {
        "accuracy": _ratio(tn + tp, n, zero_division),
        "precision": _ratio(tp, tp + fp, zero_division),
        "recall": recall,
        "specificity": specificity,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn, zero_division),
        "balanced_accuracy": (recall + specificity) / 2,
        "predicted_positive_ratio": _ratio(tp + fp, n, zero_division),
        "positive_ratio": _ratio(tp + fn, n, zero_division),
    }


def binary_metrics(df: DataFrame, threshold: float = 0.5, op: str = ">=", keys: Sequence[str] = (), zero_division: float | None = 0.0) -> DataFrame:
    return confusion(df, threshold, op, keys).withColumns(metric_columns(zero_division))


def mean_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))


def class_report(df: DataFrame, threshold: float = 0.5, op: str = ">=", keys: Sequence[str] = ()) -> DataFrame:
    """Rows negative, positive, macro avg, weighted avg of each key with precision, recall, f1, support."""
    c = confusion(df, threshold, op, keys)
    tn, fp, fn, tp = (F.col(x) for x in COUNTS)

    def side(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"), _ratio(hit, hit + wrong, 0.0).alias("precision"), _ratio(hit, hit + missed, 0.0).alias("recall"),
            _ratio(2 * hit, 2 * hit + wrong + missed, 0.0).alias("f1"), (hit + missed).alias("support"),
        )

    sides = c.select(*keys, side("negative", tn, fn, fp).alias("a"), side("positive", tp, fp, fn).alias("b"))

    def both(name, wa, wb):
        mean = lambda m: ((F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb) / (wa + wb)).alias(m)
        return F.struct(F.lit(name).alias("class"), mean("precision"), mean("recall"), mean("f1"), (F.col("a.support") + F.col("b.support")).alias("support"))

    rows = F.array("a", "b", both("macro avg", F.lit(1), F.lit(1)), both("weighted avg", F.col("a.support"), F.col("b.support")))
    return sides.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def threshold_bucket(prob: Column, lo: int, hi: int, step: int, op: str = ">=") -> Column:
    """How many of the thresholds lo, lo+step, .. hi (thousandths) the probability passes."""
    n = (hi - lo) // step + 1
    at = lambda k: (F.lit(lo) + k * step) / 1000.0
    passes = (lambda k: prob >= at(k)) if op == ">=" else (lambda k: prob > at(k))
    guess = F.least(F.greatest(F.floor((prob * 1000 - lo) / step), F.lit(-1)), F.lit(n - 1))
    # the product may be off by one place of the grid; the comparison itself decides
    fixed = F.when((guess < n - 1) & passes(guess + 1), guess + 1).when((guess >= 0) & ~passes(guess), guess - 1).otherwise(guess)
    return (fixed + 1).cast("int")


def threshold_sweep(df: DataFrame, lo: int = 50, hi: int = 950, step: int = 1, op: str = ">=", keys: Sequence[str] = (), zero_division: float | None = 0.0) -> DataFrame:
    """Counts and metrics at every grid threshold, from one bucketing pass: no row meets the grid.

    The windows run over at most one row for each key and bucket.
    """
    spark, n = df.sparkSession, (hi - lo) // step + 1
    clean = df.where(F.col("prob").isNotNull() & F.col("label").isin(0, 1))
    counts = clean.groupBy(*keys, threshold_bucket(F.col("prob"), lo, hi, step, op).alias("bucket")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    grid = spark.range(0, n + 1).select(F.col("id").cast("int").alias("bucket"))
    full = counts.select(*keys).distinct().crossJoin(F.broadcast(grid)) if keys else grid
    full = full.join(counts, [*keys, "bucket"], "left").na.fill(0, ["pos", "neg"])
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy(*keys)
    return (
        full.select(
            *keys, (F.col("bucket") * step + (lo - step)).alias("threshold_milli"), F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
            F.sum("pos").over(all_).alias("_p"), F.sum("neg").over(all_).alias("_n"), "bucket",
        )
        .where("bucket > 0")
        .select(*keys, "threshold_milli", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp")
        .withColumns(metric_columns(zero_division))
    )


def best_threshold(sweep: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest metric, the lowest threshold where several have it."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), "threshold_milli")
    return sweep.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def operating_points(
    sweep: DataFrame, min_specificity: float = 0.95, max_fn: Sequence[int] = (15, 20, 30), fixed_milli: int = 500, keys: Sequence[str] = ()
) -> DataFrame:
    """Named rows of each key's sweep: the fixed threshold, best F1, best recall at a specificity, fewest false alarms at so many misses.

    Every point is the least row among those it admits, so one aggregation over the sweep finds them all.
    """
    row = F.struct(*(c for c in sweep.columns if c not in keys))

    def least(admits: Column, *order: Column) -> Column:
        return F.min_by(F.when(admits, row), F.when(admits, F.struct(*order, F.col("threshold_milli"))))

    points = {
        "fixed": least(F.col("threshold_milli") == fixed_milli),
        "best_f1": least(F.lit(True), -F.col("f1")),
        "recall_at_specificity": least(F.col("specificity") >= min_specificity, -F.col("recall")),
        **{f"fewest_fp_fn_{n}": least(F.col("fn") <= n, F.col("fp")) for n in max_fn},
    }
    best = sweep.groupBy(*keys).agg(*(v.alias(k) for k, v in points.items()))
    named = F.array(*(F.struct(F.lit(k).alias("point"), F.col(k).alias("r")) for k in points))
    return best.select(*keys, F.explode(named).alias("x")).where("x.r IS NOT NULL").select("x.point", *keys, "x.r.*")


def predicted_counts(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return sweep.select(
        *keys, "threshold_milli", (F.col("tn") + F.col("fn")).alias("predicted_negative"), (F.col("tp") + F.col("fp")).alias("predicted_positive"),
        F.when(n > 0, (F.col("tp") + F.col("fp")) / n).alias("positive_ratio"),
    )


def class_balance(df: DataFrame, label: str = "label", majority: float = 0.7) -> DataFrame:
    """n and ratio for each label; ``imbalanced`` where the largest class reaches ``majority``."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"), F.max("n").alias("_most"))
    return n.crossJoin(F.broadcast(total)).select(
        label, "n", (F.col("n") / F.col("_total")).alias("ratio"), (F.col("_most") >= majority * F.col("_total")).alias("imbalanced")
    )


def class_summary(df: DataFrame, labels: Sequence[int] = (0, 1), label: str = "label") -> DataFrame:
    """As the balance, with a row for labels that do not occur."""
    dim = df.sparkSession.createDataFrame([(int(x),) for x in labels], "label int")
    n = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    out = F.broadcast(dim).join(n, "label", "left").na.fill(0, ["n"])
    total = df.agg(F.count("*").alias("_total"))
    return out.crossJoin(F.broadcast(total)).select("label", "n", F.when(F.col("_total") > 0, 100 * F.col("n") / F.col("_total")).otherwise(0.0).alias("percent"))


def split_label_pivot(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return df.groupBy(split).pivot(label, [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "negative", "1": "positive"})


def class_weights(df: DataFrame, labels: Sequence[int] = (0, 1), label: str = "label") -> DataFrame:
    """n / (classes * n of the class), 1 where a class is empty."""
    s = class_summary(df, labels, label)
    total = s.agg(F.sum("n").alias("_t"))
    return s.crossJoin(F.broadcast(total)).select("label", "n", F.when(F.col("n") > 0, F.col("_t") / (len(labels) * F.col("n"))).otherwise(1.0).alias("weight"))


def positive_weight(df: DataFrame, label: str = "label") -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("positives"), neg.alias("negatives")).withColumn("pos_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")))


def weighted_mean(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))).alias(f"mean_{value}"))


def numeric_by_label(df: DataFrame, cols: Sequence[str], label: str = "label", exact: bool = False) -> DataFrame:
    """Five numbers of a box plot for each column and label: quartiles, and whiskers within 1.5 of their distance.

    ``exact`` selects the quartiles over all tasks, else they are approximate. Nulls play no part; a null label is a label.
    """
    named = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols))
    long = df.select(F.col(label).alias("label"), F.explode(named).alias("x")).select("label", "x.*").where("value IS NOT NULL")
    keys, cuts = ["column", "label"], (0.25, 0.5, 0.75)
    if exact:
        box = same(long.groupBy(*keys).agg(F.count("*").alias("n")), quantiles(long, "value", cuts, keys), keys)
        box = box.select(*keys, "n", *(F.col(f"q{i}").alias(c) for i, c in enumerate(("q1", "median", "q3"))))
    else:
        box = long.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile_approx("value", q, 10_000).alias(c) for q, c in zip(cuts, ("q1", "median", "q3"), strict=True)))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - span) & (F.col("value") <= F.col("q3") + span)
    ends = same(long, box, keys).where(inside).groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return same(box, ends, keys).select("column", "label", "n", "low", "q1", "median", "q3", "high")
