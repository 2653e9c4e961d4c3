"""AUROC, average precision and curve points, exact with ties and without a global window.

Distinct scores are counted, range-partitioned by score, and cumulated in two levels: sums for each partition first
(a row a partition), then running sums inside the partitions on top of what lies below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.sources.tables import materialize


def score_table(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob", label: str = "label") -> DataFrame:
    """keys, score, pos, neg and ``pos_above``, ``neg_above`` (rows with a greater score), ``pos_all``, ``neg_all``."""
    keys = list(keys)
    counts = (
        df.where(F.col(prob).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(*keys, F.col(prob).alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    # written once, so that both levels see the same parts
    dealt = materialize(counts.repartitionByRange(*keys, F.col("score").desc()).withColumn("part", F.spark_partition_id()), "scores")
    sums = dealt.groupBy(*keys, "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    offsets = sums.select(  # a row for each key and partition
        *keys, "part", F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.sum("p").over(every).alias("pos_all"), F.sum("n").over(every).alias("neg_all"),
    )
    inside = Window.partitionBy(*keys, "part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select(
        *keys, "part", "score", "pos", "neg", F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("p1"), F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("n1")
    )
    return local.join(offsets, [*keys, "part"]).select(
        *keys, "score", "pos", "neg", (F.col("p0") + F.col("p1")).alias("pos_above"), (F.col("n0") + F.col("n1")).alias("neg_above"), "pos_all", "neg_all"
    )


def auroc(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """Mann-Whitney statistic in integers, one division at the end; null where a class is missing."""
    t = score_table(df, keys, prob)
    twice = F.sum((F.col("pos") * (2 * (F.col("neg_all") - F.col("neg_above") - F.col("neg")) + F.col("neg"))).cast("decimal(38,0)"))
    out = t.groupBy(*keys).agg(twice.alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u").cast("double") / (2.0 * F.col("p") * F.col("n"))).alias("auroc"))


def average_precision(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """Sum of precision times the step in recall; null without positives."""
    t = score_table(df, keys, prob)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    out = t.groupBy(*keys).agg(F.sum(F.col("pos") * (tp / (tp + fp))).alias("s"), F.sum("pos").alias("p"))
    return out.select(*keys, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("average_precision"))


def roc_points(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    t = score_table(df, keys, prob)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return t.select(*keys, "score", tp.alias("tp"), fp.alias("fp"), F.when(F.col("pos_all") > 0, tp / F.col("pos_all")).alias("tpr"), F.when(F.col("neg_all") > 0, fp / F.col("neg_all")).alias("fpr"))


def pr_points(df: DataFrame, keys: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    t = score_table(df, keys, prob)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return t.select(*keys, "score", (tp / (tp + fp)).alias("precision"), F.when(F.col("pos_all") > 0, tp / F.col("pos_all")).alias("recall"))
