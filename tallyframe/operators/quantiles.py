"""Exact order statistics by distributed selection: no task holds the values of a key.

Distinct values are counted and dealt by ranges; the ranks that a quantile needs follow from the sums of the parts; only
the parts that hold such a rank are read again, and cumulated inside.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.sources.tables import materialize


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` by keys of which null equals null; the keys stay once. Without keys ``b`` has one row."""
    if not keys:
        return a.join(F.broadcast(b), how="cross")
    names = {k: f"__{k}" for k in keys}
    b = b.withColumnsRenamed(names)
    met: Column = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return a.join(b, met, how).drop(*names.values())


def quantiles(df: DataFrame, value: str, at: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, q0, q1, ...: for each key the quantiles ``at`` of ``value``, between two neighbours in proportion.

    Nulls play no part; a key without values has no row, a null key is a key. Equal values count once each time they
    occur but travel as one row. NaN is the greatest value.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "values")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", "_s", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"), F.sum("_s").over(every).alias("_all"))
    points = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(at)))
    asked = sums.withColumn("_p", F.explode(points)).select("*", (F.col("_p.q") * (F.col("_all") - 1)).alias("_pos"))
    ends = F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))
    asked = asked.withColumn("_rank", F.explode(ends)).where((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_s")))
    asked = materialize(asked.select(*keys, "_part", "_off", "_pos", "_rank", F.col("_p.i").alias("_i")), "ranks")
    parts = [r[0] for r in asked.select("_part").distinct().collect()]  # part numbers
    below = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.where(F.col("_part").isin(parts)).withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    found = same(held, asked, [*keys, "_part"]).where((F.col("_rank") >= F.col("_off") + F.col("_below")) & (F.col("_rank") < F.col("_off") + F.col("_below") + F.col("_n")))
    share = F.when(F.floor("_pos") == F.ceil("_pos"), 1.0).when(F.col("_rank") == F.floor("_pos"), F.ceil("_pos") - F.col("_pos")).otherwise(F.col("_pos") - F.floor("_pos"))
    return found.groupBy(*keys).agg(*(F.sum(F.when(F.col("_i") == i, F.col("_v") * share)).alias(f"q{i}") for i in range(len(at))))
