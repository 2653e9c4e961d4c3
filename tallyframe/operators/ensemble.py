"""Views, folds, blends, weight search, stacking, pseudo-labels and comparisons of models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.columns import binarize, sigmoid
from tallyframe.operators.curves import score_table
from tallyframe.operators.metrics import binary_metrics, metric_columns, threshold_bucket
from tallyframe.operators.quantiles import quantiles, same
from tallyframe.sources.tables import materialize


def mean_over_views(df: DataFrame, value: str = "prob", keys: Sequence[str] = ("sample_id", "label", "model", "fold")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def mean_over_folds(df: DataFrame, value: str = "prob", keys: Sequence[str] = ("sample_id", "label", "model")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def pivot_models(df: DataFrame, models: Sequence, label: str | None = "label", value: str = "prob", require_complete: bool = True) -> DataFrame:
    """A row a sample with a column ``m_<model>`` each; incomplete samples go, or stay with nulls. One shuffle, no joins."""
    keys = ["sample_id", *([label] if label else [])]
    wide = df.where(F.col("model").isin(list(models))).groupBy(*keys).agg(
        *(F.max(F.when(F.col("model") == m, F.col(value))).alias(f"m_{m}") for m in models)
    )
    return wide.dropna(subset=[f"m_{m}" for m in models]) if require_complete else wide


def assert_aligned(wide: DataFrame, n: int) -> None:
    if (found := wide.count()) != n:
        raise ValueError(f"{found} aligned rows, expected {n}")


def missing_model_folds(df: DataFrame, models: Sequence, folds: Sequence) -> DataFrame:
    """Pairs of the expected grid that have no prediction."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(m, f) for m in models for f in folds], "model int, fold long")
    seen = df.select(F.col("model").cast("int").alias("model"), F.col("fold").cast("long").alias("fold")).distinct()
    return grid.join(seen, ["model", "fold"], "left_anti")


def blend(df: DataFrame, weights: DataFrame, value: str = "prob", keys: Sequence[str] = ("sample_id", "label")) -> DataFrame:
    """Weighted sum over models; models of weight 0 are left out before the join."""
    used = F.broadcast(weights.where("weight > 0"))
    return df.join(used, "model").groupBy(*keys).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias(value))


def f1_weights(fold_metrics: DataFrame, eps: float = 1e-8) -> DataFrame:
    avg = fold_metrics.groupBy("model").agg(F.avg("f1").alias("avg_f1"))
    return avg.crossJoin(F.broadcast(avg.agg(F.sum("avg_f1").alias("_t")))).select("model", "avg_f1", (F.col("avg_f1") / (F.col("_t") + eps)).alias("weight"))


def simplex_grid(spark: SparkSession, models: Sequence, steps: int = 20) -> DataFrame:
    """(weight_id, w_<model>..) in whole steps that add up to ``steps``."""
    grid = reduce(lambda a, m: a.crossJoin(spark.range(steps + 1).select(F.col("id").cast("int").alias(f"w_{m}"))), models[1:], spark.range(steps + 1).select(F.col("id").cast("int").alias(f"w_{models[0]}")))
    names = [f"w_{m}" for m in models]
    kept = grid.where(sum((F.col(n) for n in names), F.lit(0)) == steps)
    number = reduce(lambda a, n: a * (steps + 1) + F.col(n), names, F.lit(0))
    return kept.select(number.cast("int").alias("weight_id"), *names)


def grid_search(wide: DataFrame, weights: DataFrame, models: Sequence, steps: int, lo: int, hi: int, step: int, metric: str = "accuracy", scale: int = 1) -> DataFrame:
    """The best weights and threshold: weight_id, threshold_milli, counts and metrics.

    Each sample meets the weights (a broadcast of a few hundred rows) inside its task, is bucketed, and is summed there;
    what is shuffled is at most one row for each task, weight and bucket. ``scale`` divides integer values.
    """
    total = sum((F.col(f"m_{m}") * F.col(f"w_{m}") for m in models), F.lit(0))
    scored = wide.crossJoin(F.broadcast(weights)).select("weight_id", "label", (total / (steps * float(scale))).alias("prob"))
    counts = scored.groupBy("weight_id", threshold_bucket(F.col("prob"), lo, hi, step).alias("bucket")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    n = (hi - lo) // step + 1
    grid = weights.select("weight_id").crossJoin(wide.sparkSession.range(0, n + 1).select(F.col("id").cast("int").alias("bucket")))
    full = grid.join(counts, ["weight_id", "bucket"], "left").na.fill(0, ["pos", "neg"])
    up = Window.partitionBy("weight_id").orderBy("bucket").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy("weight_id")
    swept = full.select(
        "weight_id", "bucket", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(every).alias("_p"), F.sum("neg").over(every).alias("_n")
    ).where("bucket > 0").select(
        "weight_id", (F.col("bucket") * step + (lo - step)).alias("threshold_milli"), (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp"
    )
    return swept.withColumns(metric_columns()).orderBy(F.col(metric).desc(), "weight_id", "threshold_milli").limit(1)


def refine_search(wide: DataFrame, models: Sequence, best: dict, steps: int = 20, rounds: int = 2, reach: int = 2, **options) -> DataFrame:
    """Coarse-to-fine: each round halves the step around the winner's weights. ``best`` holds weight_id, w_<model> and steps."""
    spark, out = wide.sparkSession, None
    at = {m: best[f"w_{m}"] for m in models}
    for _ in range(rounds):
        steps, at = steps * 2, {m: w * 2 for m, w in at.items()}
        near = reduce(lambda a, b: a & b, (F.abs(F.col(f"w_{m}") - at[m]) <= reach for m in models))
        grid = simplex_grid(spark, models, steps).where(near)
        out = materialize(grid_search(wide, grid, models, steps, **options).join(grid, "weight_id"), "refined")  # one row, searched once
        row = out.first()
        at = {m: row[f"w_{m}"] for m in models}
    return out.withColumn("steps", F.lit(steps))


def apply_best(wide: DataFrame, best: DataFrame, models: Sequence, steps: int, scale: int = 1) -> DataFrame:
    """The winner's probabilities, threshold and decisions for every sample."""
    total = sum((F.col(f"m_{m}") * F.col(f"w_{m}") for m in models), F.lit(0))
    return wide.crossJoin(F.broadcast(best)).select(
        "sample_id", "label", (total / (steps * float(scale))).alias("prob"), "threshold_milli"
    ).withColumn("pred", binarize(F.col("prob"), F.col("threshold_milli") / 1000.0))


def prob_stats(df: DataFrame, keys: Sequence[str] = (), value: str = "prob") -> DataFrame:
    """Both deviations are named: of the population and of a sample. The median is selected over all tasks; null keys are keys."""
    sums = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"),
    )
    both = same(sums, quantiles(df, value, [0.5], keys), keys, "left")
    return both.select(*keys, "n", "min", "max", "mean", F.col("q0").alias("median"), "std_pop", "std_samp")


def prob_histogram(df: DataFrame, bins: int = 25, keys: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """n and density of equal bins on [0, 1]; the last one is closed, empty ones are there."""
    at = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(prob).between(0, 1)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = n.select(*keys).distinct().crossJoin(F.broadcast(grid)) if keys else grid
    full = full.join(n, [*keys, "bin"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*keys))
    return full.select(*keys, "bin", "n", F.when(total > 0, F.col("n") * bins / total).alias("density"))


def model_correlation(wide: DataFrame, models: Sequence) -> DataFrame:
    """Pearson correlation of every pair, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    row = wide.agg(*(F.corr(f"m_{a}", f"m_{b}").alias(f"c_{a}_{b}") for a, b in pairs))
    cells = F.array(*(F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"c_{a}_{b}").alias("correlation")) for a, b in pairs))
    return row.select(F.explode(cells).alias("x")).select("x.*")


def error_jaccard(wide: DataFrame, models: Sequence, threshold: float, op: str = ">=", scale: float = 1.0) -> DataFrame:
    """Overlap of the sets of wrong samples for every pair; 1 where neither errs. One aggregation, no self-join."""
    wrong = {m: binarize(F.col(f"m_{m}") / scale, threshold, op) != F.col("label") for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    row = wide.agg(
        *(F.count_if(wrong[a] & wrong[b]).alias(f"i_{a}_{b}") for a, b in pairs), *(F.count_if(wrong[a] | wrong[b]).alias(f"u_{a}_{b}") for a, b in pairs)
    )
    cells = F.array(*(
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"i_{a}_{b}").alias("both"), F.col(f"u_{a}_{b}").alias("either"),
                 F.when(F.col(f"u_{a}_{b}") > 0, F.col(f"i_{a}_{b}") / F.col(f"u_{a}_{b}")).otherwise(1.0).alias("jaccard"))
        for a, b in pairs
    ))
    return row.select(F.explode(cells).alias("x")).select("x.*")


def pseudo_labels(df: DataFrame, low: float, high: float, inclusive: bool = True, weight: float = 0.35, cap: int | None = None) -> DataFrame:
    """Confident rows of both tails: sample_id, prob, label, pseudo_confidence, sample_weight, group_id.

    ``cap`` keeps the most confident, ties by id.
    """
    p = F.col("prob")
    neg, pos = ((p <= low), (p >= high)) if inclusive else ((p < low), (p > high))
    out = df.where(neg | pos).select(
        "sample_id", "prob", F.when(pos, 1).otherwise(0).alias("label"), F.greatest(p, 1 - p).alias("pseudo_confidence"),
        F.lit(weight).alias("sample_weight"), F.concat(F.lit("pseudo_"), F.col("sample_id").cast("string")).alias("group_id"),
    )
    return most_confident(out, cap) if cap is not None else out


def most_confident(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.col("pseudo_confidence").desc(), "sample_id").limit(n)


def with_pseudo(real: DataFrame, pseudo: DataFrame, weight: float = 0.35, fold: int | None = None) -> DataFrame:
    """Real rows of weight 1 and pseudo-labelled ones; with ``fold``, the real rows of the other folds only, for training."""
    if fold is not None:
        real = real.where(F.col("fold") != fold)
    return real.withColumn("sample_weight", F.lit(1.0)).unionByName(pseudo.withColumn("sample_weight", F.lit(weight)), allowMissingColumns=True)


def prob_shift(before: DataFrame, after: DataFrame, bins: int = 25) -> DataFrame:
    both = before.select(F.lit("before").alias("stage"), "prob").union(after.select(F.lit("after"), "prob"))
    return prob_histogram(both, bins, ["stage"])


def compare_decisions(scored: DataFrame, packaged: DataFrame, threshold: float) -> DataFrame:
    """Samples whose decisions differ or that one side lacks."""
    a = scored.select("sample_id", F.col("prob").alias("prob_a"))
    b = packaged.select("sample_id", F.col("prob").alias("prob_b"))
    both = a.join(b, "sample_id", "full").withColumns({"pred_a": binarize(F.col("prob_a"), threshold), "pred_b": binarize(F.col("prob_b"), threshold)})
    return both.where(~F.col("pred_a").eqNullSafe(F.col("pred_b")))


def score_drift(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    d = a.select(key, F.col("prob").alias("_a")).join(b.select(key, F.col("prob").alias("_b")), key).select(F.abs(F.col("_a") - F.col("_b")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.max("d").alias("max_drift"), F.avg("d").alias("mean_drift"))


class Stacker:
    """Logistic regression over standardised model probabilities; ``loss`` is the penalised one after ``rounds`` rounds."""

    def __init__(self, models: Sequence, means: Sequence[float], stds: Sequence[float], weights: Sequence[float], rounds: int, loss: float):
        self.models, self.means, self.stds, self.rounds, self.loss = list(models), list(means), list(stds), rounds, loss
        self.coefficients, self.intercept = list(weights[:-1]), weights[-1]

    def transform(self, wide: DataFrame) -> DataFrame:
        """``wide`` with prob, a plain expression; null where a model's value is null."""
        return wide.withColumn("prob", sigmoid(_linear(_standard(self.models, self.means, self.stds), [*self.coefficients, self.intercept])))

    def table(self, spark: SparkSession) -> DataFrame:
        """(term, value): a row a model, and the intercept."""
        rows = [(f"m_{m}", c) for m, c in zip(self.models, self.coefficients)]
        return spark.createDataFrame([*rows, ("intercept", self.intercept)], "term string, value double")


def _standard(models: Sequence, means: Sequence[float], stds: Sequence[float]) -> list[Column]:
    return [(F.col(f"m_{m}") - mean) / std for m, mean, std in zip(models, means, stds)] + [F.lit(1.0)]


def _linear(x: Sequence[Column], w: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(v)) * c for v, c in zip(w, x)))


def fit_stacker(wide: DataFrame, models: Sequence, C: float = 0.5, max_rounds: int = 50, tol: float = 1e-10) -> Stacker:  # noqa: N803
    """Least sum of log losses plus half the squared coefficients over ``C``; the intercept is not penalised.

    Newton's method. A round is one aggregation of the loss, the gradient and the upper half of the second derivatives,
    (d + 1)(d + 4) / 2 + 1 sums for d models; only those come to the driver. A step that raises the loss is halved. Rows with
    a null value or a label besides 0 and 1 are left out; a table without both classes raises, a constant column keeps
    coefficient 0.
    """
    whole = reduce(lambda a, m: a & F.col(f"m_{m}").isNotNull(), models, F.col("label").isin(0, 1))
    used = materialize(wide.where(whole).select("label", *(F.col(f"m_{m}").cast("double").alias(f"m_{m}") for m in models)), "stacker")
    row = used.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *(f(f"m_{m}") for m in models for f in (F.avg, F.stddev_pop))).first()
    if not row[0] or not row[1]:
        raise ValueError("a stacker needs rows of both classes")
    means, stds = list(row[2::2]), [v or 1.0 for v in row[3::2]]
    d = len(models)
    x, penalty = _standard(models, means, stds), np.diag([1.0 / C] * d + [0.0])
    upper = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z, y = _linear(x, w), F.col("label")
        p = sigmoid(F.col("_z"))
        loss = F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z"))) - y * F.col("_z")
        rows = used.withColumn("_z", z).withColumns({"_p": p, "_l": loss})
        got = rows.agg(F.sum("_l"), *(F.sum((F.col("_p") - y) * c) for c in x), *(F.sum(F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i, j in upper)).first()
        second = np.zeros((d + 1, d + 1))
        for (i, j), v in zip(upper, got[d + 2 :]):
            second[i, j] = second[j, i] = v
        return got[0] + 0.5 * w @ penalty @ w, np.array(got[1 : d + 2]) + penalty @ w, second + penalty

    w = np.zeros(d + 1)
    loss, gradient, second = sums(w)
    for done in range(1, max_rounds + 1):
        step = np.linalg.lstsq(second, gradient, rcond=None)[0]
        near = sums(w - step)
        while near[0] > loss * (1 + 1e-12) and np.abs(step).max() > tol:
            step = step / 2
            near = sums(w - step)
        w, (loss, gradient, second) = w - step, near
        if np.abs(step).max() <= tol * max(1.0, np.abs(w).max()):
            return Stacker(models, means, stds, w.tolist(), done, loss)
    raise RuntimeError(f"the stacker did not settle in {max_rounds} rounds")


def line_search(wide: DataFrame, weights: dict, models: Sequence, cut: float) -> DataFrame:
    """The best place on each line of the simplex through ``weights``, one line a model: model, t_lo, t_hi, right, start_right.

    On the line of model m its share t runs from 0 to 1 and the others share 1 - t as they do in ``weights`` (alike, where m
    has all). At the threshold ``cut``, in the units of the values, a sample changes sides at one t at most, so the samples
    judged rightly are counted exactly by one running sum over the sorted crossings, which stand in range partitions.
    ``right`` samples are right all over the open interval (t_lo, t_hi), the first of the best; ``start_right`` at ``weights``.
    Rows with a null value or label are left out; without rows there is no line.
    """
    spark, total = wide.sparkSession, sum(weights[m] for m in models)
    whole = reduce(lambda a, m: a & F.col(f"m_{m}").isNotNull(), models, F.col("label").isin(0, 1))
    at_start = reduce(lambda a, b: a + b, (F.col(f"m_{m}") * weights[m] for m in models)) >= cut * total
    lines = []
    for m in models:
        rest = {o: weights[o] for o in models if o != m}
        if not sum(rest.values()):
            rest = dict.fromkeys(rest, 1)
        share, others = sum(rest.values()), reduce(lambda a, b: a + b, (F.col(f"m_{o}") * w for o, w in rest.items()))
        lines.append(F.struct(F.lit(str(m)).alias("model"), (F.lit(cut * share) - others).alias("num"), (F.col(f"m_{m}") * share - others).alias("den")))
    crossed = wide.where(whole).select("label", at_start.alias("_s"), F.explode(F.array(*lines)).alias("x")).select("label", "_s", "x.*")
    truth, after = F.col("label") == 1, (F.col("num") < 0) | ((F.col("num") == 0) & (F.col("den") >= 0))
    base = materialize(crossed.groupBy("model").agg(F.count_if(truth == after).alias("base"), F.count_if(truth == F.col("_s")).alias("start_right")), "line-starts")
    events = crossed.where("den <> 0").select("model", (-(F.col("num").cast("double") / F.col("den"))).alias("score"), (truth == (F.col("den") > 0)).cast("int").alias("label"))
    sums = score_table(events.where("score < 0 AND score > -1"), ["model"], "score")
    gained = F.col("pos_above") + F.col("pos") - F.col("neg_above") - F.col("neg")
    cells = sums.join(F.broadcast(base), "model").select("model", (-F.col("score")).alias("t"), (F.col("base") + gained).alias("right"))
    cells = cells.union(base.select("model", F.lit(0.0), "base"))
    best = cells.groupBy("model").agg(F.max(F.struct("right", (-F.col("t")).alias("u"))).alias("b")).select("model", F.abs("b.u").alias("t_lo"), "b.right")
    best = F.broadcast(materialize(best, "line-best"))  # a row a model
    ends = cells.select("model", "t").join(best.select("model", "t_lo"), "model").where("t > t_lo").groupBy("model").agg(F.min("t").alias("t_hi"))
    return best.join(ends, "model", "left").join(base, "model").select("model", "t_lo", F.coalesce("t_hi", F.lit(1.0)).alias("t_hi"), "right", "start_right")


def line_refine(wide: DataFrame, weights: dict, models: Sequence, cut: float, rounds: int = 10) -> tuple[dict, int]:
    """(weights that add up to 1, samples right there): line after line from ``weights``, until no line is better.

    Never worse than the start. Each round searches the lines of all models in one pass and goes to the middle of the best
    interval; the driver sees a row a model.
    """
    now, right = {m: float(weights[m]) / sum(weights.values()) for m in models}, None
    wide = materialize(wide, "lines")
    for _ in range(rounds):
        rows = line_search(wide, weights, models, cut).collect()
        right = max((r.start_right for r in rows), default=0)
        better = sorted((r for r in rows if r.right > right), key=lambda r: (-r.right, -(r.t_hi - r.t_lo), r.model))
        if not better:
            break
        m = next(x for x in models if str(x) == better[0].model)
        t, rest = (better[0].t_lo + better[0].t_hi) / 2, sum(now[o] for o in models if o != m)
        weights = now = {o: t if o == m else (1 - t) * (now[o] / rest if rest else 1 / (len(models) - 1)) for o in models}
    return now, right or 0


def fold_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return binary_metrics(df, threshold, keys=["model", "fold"])
