"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import curves, duplicates, ensemble, metrics, results, splits
from tallyframe.plans import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_FAMILY = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "predicted_positive_ratio", "positive_ratio")


def _family(n: int = 9) -> str:
    d = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0::DOUBLE END"
    all_ = "(tn + fp + fn + tp)"
    cols = {
        "accuracy": d("(tn + tp)", all_), "precision": d("tp", "(tp + fp)"), "recall": d("tp", "(tp + fn)"), "specificity": d("tn", "(tn + fp)"),
        "f1": d("(2 * tp)", "(2 * tp + fp + fn)"), "balanced_accuracy": f"({d('tp', '(tp + fn)')} + {d('tn', '(tn + fp)')}) / 2",
        "predicted_positive_ratio": d("(tp + fp)", all_), "positive_ratio": d("(tp + fn)", all_),
    }
    return ", ".join(f"round({v}, {n}) AS {k}" for k, v in cols.items())


def _counts(prob: str, cut: str, label: str = "label") -> str:
    f = lambda y, op: f"count(*) FILTER (WHERE {label} = {y} AND {prob} {op} {cut})"
    return f"{f(0, '<')} AS tn, {f(0, '>=')} AS fp, {f(1, '<')} AS fn, {f(1, '>=')} AS tp"


# -- class balance ----------------------------------------------------------------------------------


@query(f"""WITH {X.SAMPLES_SQL}, n AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT label, n, n / CAST((SELECT sum(n) FROM n) AS DOUBLE) AS ratio, (SELECT max(n) FROM n) >= CAST(0.7 AS DOUBLE) * (SELECT sum(n) FROM n) AS imbalanced FROM n""")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.class_balance(X.samples(spark, sf))


@query(f"""WITH {X.SAMPLES_SQL}, dim AS (SELECT unnest([0, 1, 2]) AS label)
SELECT label, count(sample_id) AS n, round(100 * count(sample_id) / CAST((SELECT count(*) FROM samples) AS DOUBLE), 9) AS percent FROM dim LEFT JOIN samples USING (label) GROUP BY label""")
def class_summary(spark, sf):
    return rounded(metrics.class_summary(X.samples(spark, sf), [0, 1, 2]), "percent")


@query(f"""WITH {X.SAMPLES_SQL} SELECT CASE WHEN fold = 0 THEN 'val' ELSE 'train' END AS split, count(*) FILTER (WHERE label = 0) AS negative,
count(*) FILTER (WHERE label = 1) AS positive FROM samples GROUP BY 1""")
def split_label_pivot(spark, sf):
    return metrics.split_label_pivot(X.samples(spark, sf).withColumn("split", F.when(F.col("fold") == 0, "val").otherwise("train")))


@query(f"""WITH {X.SAMPLES_SQL} SELECT label, count(*) AS n, (SELECT count(*) FROM samples) / (2.0::DOUBLE * count(*)) AS weight FROM samples GROUP BY label""")
def class_weights(spark, sf):
    return metrics.class_weights(X.samples(spark, sf))


@query(f"""WITH {X.SAMPLES_SQL} SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives,
CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE label = 1), 0) AS pos_weight FROM samples""")
def positive_weight(spark, sf):
    return metrics.positive_weight(X.samples(spark, sf))


# -- metrics at thresholds -----------------------------------------------------------------------


@query(f"WITH {X.PREDICTIONS_SQL} SELECT model, {_counts('ppm', '400000')} FROM p GROUP BY model")
def confusion_by_model(spark, sf):
    return metrics.confusion(X.predictions(spark, sf), 0.4, keys=["model"])


@query(f"WITH {X.PREDICTIONS_SQL}, c AS (SELECT model, fold, {_counts('ppm', '500000')} FROM p GROUP BY model, fold) SELECT model, fold, tn, fp, fn, tp, {_family()} FROM c")
def metrics_by_model_fold(spark, sf):
    return rounded(metrics.binary_metrics(X.predictions(spark, sf), 0.5, keys=["model", "fold"]), *_FAMILY)


@query(f"""WITH {X.PREDICTIONS_SQL}, c AS (SELECT {_counts('ppm', '400000')} FROM p),
s AS (SELECT 'negative' AS class, tn / CAST(tn + fn AS DOUBLE) AS precision, tn / CAST(tn + fp AS DOUBLE) AS recall, 2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f1, tn + fp AS support FROM c
      UNION ALL SELECT 'positive', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE), 2 * tp / CAST(2 * tp + fn + fp AS DOUBLE), tp + fn FROM c)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM s
UNION ALL SELECT 'macro avg', round(sum(precision) / 2, 9), round(sum(recall) / 2, 9), round(sum(f1) / 2, 9), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM s""")
def class_report(spark, sf):
    return rounded(metrics.class_report(X.predictions(spark, sf), 0.4), "precision", "recall", "f1")


_SWEEP = f"""h AS (SELECT model, label, least(950, greatest(49, ppm // 1000)) AS milli, count(*) AS k FROM p GROUP BY 1, 2, 3), t AS (SELECT unnest(range(50, 951)) AS threshold_milli),
c AS (SELECT model, threshold_milli, CAST(coalesce(sum(k) FILTER (WHERE label = 0 AND milli < threshold_milli), 0) AS BIGINT) AS tn, CAST(coalesce(sum(k) FILTER (WHERE label = 0 AND milli >= threshold_milli), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(k) FILTER (WHERE label = 1 AND milli < threshold_milli), 0) AS BIGINT) AS fn, CAST(coalesce(sum(k) FILTER (WHERE label = 1 AND milli >= threshold_milli), 0) AS BIGINT) AS tp FROM h CROSS JOIN t GROUP BY model, threshold_milli),
sweep AS (SELECT model, threshold_milli, tn, fp, fn, tp, {_family()} FROM c)"""


@query(f"WITH {X.PREDICTIONS_SQL}, {_SWEEP} SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    """Every threshold from 0.05 to 0.95 for each model, from one pass."""
    return rounded(metrics.threshold_sweep(X.predictions(spark, sf), keys=["model"]), *_FAMILY)


def _best(metric: str) -> str:
    return f"""WITH {X.PREDICTIONS_SQL}, {_SWEEP} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {metric} DESC, threshold_milli) AS r FROM sweep) WHERE r = 1"""


@query(_best("accuracy"))
def best_threshold_accuracy(spark, sf):
    return metrics.best_threshold(threshold_sweep(spark, sf), "accuracy", ["model"])


@query(_best("f1"))
def best_threshold_f1(spark, sf):
    return metrics.best_threshold(threshold_sweep(spark, sf), "f1", ["model"])


@query(f"""WITH {X.PREDICTIONS_SQL}, {_SWEEP}, o AS (SELECT 'fixed' AS point, *, 0::DOUBLE AS o FROM sweep WHERE threshold_milli = 500
UNION ALL SELECT 'best_f1', *, -f1 FROM sweep
UNION ALL SELECT 'recall_at_specificity', *, -recall FROM sweep WHERE specificity >= CAST(0.95 AS DOUBLE)
UNION ALL SELECT 'fewest_fp_fn_100', *, fp FROM sweep WHERE fn <= 100
UNION ALL SELECT 'fewest_fp_fn_1000', *, fp FROM sweep WHERE fn <= 1000)
SELECT * EXCLUDE (o, r) FROM (SELECT *, row_number() OVER (PARTITION BY model, point ORDER BY o, threshold_milli) AS r FROM o) WHERE r = 1""")
def operating_points(spark, sf):
    return metrics.operating_points(threshold_sweep(spark, sf), max_fn=(100, 1000), keys=["model"])


@query(f"""WITH {X.PREDICTIONS_SQL}, {_SWEEP} SELECT model, threshold_milli, tn + fn AS predicted_negative, tp + fp AS predicted_positive,
CAST(tp + fp AS DOUBLE) / (tn + fp + fn + tp) AS positive_ratio FROM c""")
def predicted_counts(spark, sf):
    return metrics.predicted_counts(threshold_sweep(spark, sf), ["model"])


# -- curves ---------------------------------------------------------------------------------------

_RANKED = """s AS (SELECT model, ppm, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM p GROUP BY model, ppm),
r AS (SELECT *, CAST(sum(pos) OVER q AS BIGINT) AS tp, CAST(sum(neg) OVER q AS BIGINT) AS fp, CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS pa, CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS na
      FROM s WINDOW q AS (PARTITION BY model ORDER BY ppm DESC))"""


@query(f"WITH {X.PREDICTIONS_SQL}, {_RANKED} SELECT model, CAST(sum(pos * (2 * (na - fp) + neg)) AS DOUBLE) / (2.0 * max(pa) * max(na)) AS auroc FROM r GROUP BY model")
def auroc_by_model(spark, sf):
    return curves.auroc(X.predictions(spark, sf), ["model"])


@query(f"WITH {X.PREDICTIONS_SQL}, {_RANKED} SELECT model, round(sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(pa), 9) AS average_precision FROM r GROUP BY model")
def average_precision_by_model(spark, sf):
    return rounded(curves.average_precision(X.predictions(spark, sf), ["model"]), "average_precision")


@query(f"WITH {X.PREDICTIONS_SQL}, {_RANKED} SELECT model, ppm AS score, tp, fp, CAST(tp AS DOUBLE) / pa AS tpr, CAST(fp AS DOUBLE) / na AS fpr FROM r")
def roc_points(spark, sf):
    return curves.roc_points(X.predictions(spark, sf), ["model"], prob="ppm")


@query(f"WITH {X.PREDICTIONS_SQL}, {_RANKED} SELECT model, ppm AS score, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / pa AS recall FROM r")
def pr_points(spark, sf):
    return curves.pr_points(X.predictions(spark, sf), ["model"], prob="ppm")


# -- ensembles ----------------------------------------------------------------------------------------


@query(f"WITH {X.VIEWS_SQL} SELECT sample_id, label, model, fold, s4 / 4.0::DOUBLE AS ppm FROM v")
def view_mean(spark, sf):
    return ensemble.mean_over_views(X.predictions(spark, sf), "ppm")


@query(f"WITH {X.VIEWS_SQL} SELECT sample_id, label, model, avg(s4 / 4.0::DOUBLE) AS ppm FROM v GROUP BY sample_id, label, model")
def fold_mean(spark, sf):
    return ensemble.mean_over_folds(ensemble.mean_over_views(X.predictions(spark, sf), "ppm"), "ppm")


@query(f"WITH {X.VIEWS_SQL} SELECT * FROM w WHERE m_0 IS NOT NULL AND m_1 IS NOT NULL AND m_2 IS NOT NULL")
def pivot_models(spark, sf):
    return ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4")


@query(f"WITH {X.VIEWS_SQL} SELECT sample_id, label, round((15 * m_0 + 3 * m_1) / (4.0::DOUBLE * 18), 6) AS ppm FROM w")
def ensemble_blend(spark, sf):
    weights = spark.createDataFrame([(0, 15), (1, 3), (2, 0)], "model int, weight int")
    return rounded(ensemble.blend(X.views(spark, sf).withColumn("ppm", F.col("s4") / 4), weights, "ppm"), "ppm", digits=6)


@query(f"""WITH {X.PREDICTIONS_SQL}, c AS (SELECT model, fold, {_counts('ppm', '500000')} FROM p GROUP BY model, fold),
a AS (SELECT model, avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)) AS avg_f1 FROM c GROUP BY model)
SELECT model, round(avg_f1, 9) AS avg_f1, round(avg_f1 / ((SELECT sum(avg_f1) FROM a) + CAST(1e-8 AS DOUBLE)), 9) AS weight FROM a""")
def f1_weights(spark, sf):
    return rounded(ensemble.f1_weights(ensemble.fold_metrics(X.predictions(spark, sf))), "avg_f1", "weight")


def _grid(lo: int, hi: int, step: int) -> str:
    """All weight triples in twentieths at thresholds lo, lo + step, .. hi (thousandths)."""
    n = (hi - lo) // step + 1
    return f"""g AS (SELECT a AS w_0, b AS w_1, 20 - a - b AS w_2, (a * 21 + b) * 21 + 20 - a - b AS weight_id FROM (SELECT unnest(range(21)) AS a), (SELECT unnest(range(21)) AS b) WHERE a + b <= 20),
h AS (SELECT weight_id, greatest(-1, least({n - 1}, (m_0 * w_0 + m_1 * w_1 + m_2 * w_2 - {(lo - step) * 80_000}) // {step * 80_000} - 1)) AS slot,
  count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM w CROSS JOIN g GROUP BY 1, 2),
d AS (SELECT weight_id, slot, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM (SELECT weight_id, unnest(range(-1, {n})) AS slot FROM g) LEFT JOIN h USING (weight_id, slot)),
c AS (SELECT weight_id, slot, {lo} + {step} * slot AS cut, CAST(sum(neg) OVER below - neg AS BIGINT) AS tn, CAST(sum(neg) OVER every - sum(neg) OVER below + neg AS BIGINT) AS fp,
  CAST(sum(pos) OVER below - pos AS BIGINT) AS fn, CAST(sum(pos) OVER every - sum(pos) OVER below + pos AS BIGINT) AS tp FROM d
  WINDOW below AS (PARTITION BY weight_id ORDER BY slot), every AS (PARTITION BY weight_id))"""


@query(f"""WITH {X.VIEWS_SQL}, {_grid(50, 950, 1)} SELECT CAST(weight_id AS INTEGER) AS weight_id, CAST(cut AS INTEGER) AS threshold_milli, tn, fp, fn, tp, {_family()} FROM c
WHERE slot >= 0 ORDER BY (tn + tp) DESC, weight_id, cut LIMIT 1""")
def grid_search_best(spark, sf):
    """All 231 weight triples at 901 thresholds in one aggregation, by accuracy."""
    wide = ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4")
    best = ensemble.grid_search(wide, ensemble.simplex_grid(spark, X.MODELS), X.MODELS, 20, 50, 950, 1, scale=4000000)
    return rounded(best, *_FAMILY)


@query(f"""WITH {X.VIEWS_SQL}, {_grid(200, 800, 5)} SELECT CAST(weight_id AS INTEGER) AS weight_id, CAST(cut AS INTEGER) AS threshold_milli, tn, fp, fn, tp, {_family()} FROM c
WHERE slot >= 0 ORDER BY CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) DESC, weight_id, cut LIMIT 1""")
def grid_search_f1(spark, sf):
    """All 231 weight triples at 121 thresholds in one aggregation, by F1."""
    wide = ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4")
    best = ensemble.grid_search(wide, ensemble.simplex_grid(spark, X.MODELS), X.MODELS, 20, 200, 800, 5, "f1", scale=4000000)
    return rounded(best, *_FAMILY)


@query()
def weight_refine(spark, sf):
    """Coarse to fine around the winner; tested against the full grid at the finer step."""
    wide = ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4")
    grid = ensemble.simplex_grid(spark, X.MODELS)
    options = {"lo": 50, "hi": 950, "step": 1, "scale": 4000000}
    best = ensemble.grid_search(wide, grid, X.MODELS, 20, **options).join(grid, "weight_id").first().asDict()  # one row
    return ensemble.refine_search(wide, X.MODELS, best, **options)


@query(f"""WITH {X.PREDICTIONS_SQL} SELECT model, count(*) AS n, min(ppm) AS min, max(ppm) AS max, round(avg(ppm), 6) AS mean, round(median(ppm), 6) AS median, round(stddev_pop(ppm), 3) AS std_pop, round(stddev_samp(ppm), 3) AS std_samp FROM p GROUP BY model""")
def prob_stats(spark, sf):
    return rounded(rounded(ensemble.prob_stats(X.predictions(spark, sf), ["model"], "ppm"), "mean", "median", digits=6), "std_pop", "std_samp", digits=3)


@query(f"""WITH {X.PREDICTIONS_SQL}, n AS (SELECT model, least(24, ppm // 40000) AS bin, count(*) AS n FROM p GROUP BY 1, 2), grid AS (SELECT DISTINCT model, bin FROM p, (SELECT unnest(range(25)) AS bin))
SELECT model, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) * 25 / CAST((SELECT count(*) FROM p x WHERE x.model = grid.model) AS DOUBLE), 9) AS density FROM grid LEFT JOIN n USING (model, bin)""")
def prob_histogram(spark, sf):
    # ppm / 40000 floors as the product of the probability and 25 does, but for places next to a bound
    p = X.predictions(spark, sf).withColumn("prob", (F.col("ppm") + 0.5) / 1000000.0)
    return rounded(ensemble.prob_histogram(p, 25, ["model"]), "density")


_PAIRS = "(SELECT unnest([0, 0, 0, 1, 1, 2]) AS model_a, unnest([0, 1, 2, 1, 2, 2]) AS model_b)"
_PICK = "CASE {m} WHEN 0 THEN m_0 WHEN 1 THEN m_1 ELSE m_2 END"


@query(f"""WITH {X.VIEWS_SQL} SELECT model_a, model_b, round(corr({_PICK.format(m='model_a')}, {_PICK.format(m='model_b')}), 6) AS correlation FROM w CROSS JOIN {_PAIRS} GROUP BY model_a, model_b""")
def model_correlation(spark, sf):
    return rounded(ensemble.model_correlation(ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4"), X.MODELS), "correlation", digits=6)


@query(f"""WITH {X.VIEWS_SQL}, e AS (SELECT model_a, model_b, (({_PICK.format(m='model_a')}) >= 2000000) <> (label = 1) AS a, (({_PICK.format(m='model_b')}) >= 2000000) <> (label = 1) AS b FROM w CROSS JOIN {_PAIRS})
SELECT model_a, model_b, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a OR b) AS either, CASE WHEN count(*) FILTER (WHERE a OR b) > 0 THEN CAST(count(*) FILTER (WHERE a AND b) AS DOUBLE) / count(*) FILTER (WHERE a OR b) ELSE 1.0 END AS jaccard FROM e GROUP BY model_a, model_b""")
def error_jaccard(spark, sf):
    return ensemble.error_jaccard(ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4"), X.MODELS, 0.5, scale=4000000.0)


@query(f"""WITH {X.PREDICTIONS_SQL}, seen AS (SELECT DISTINCT model, fold FROM p WHERE NOT (model = 1 AND fold = 3))
SELECT model, fold FROM (SELECT unnest([0, 1, 2]) AS model), (SELECT CAST(unnest(range(5)) AS BIGINT) AS fold) EXCEPT SELECT model, fold FROM seen""")
def model_fold_completeness(spark, sf):
    return ensemble.missing_model_folds(X.predictions(spark, sf).where("NOT (model = 1 AND fold = 3)"), X.MODELS, range(5))


@query(f"""WITH {X.VIEWS_SQL}, b AS (SELECT sample_id, label, m_0 + m_1 + m_2 AS s12 FROM w)
SELECT sample_id, label, s12, CASE WHEN s12 >= 4800000 THEN 1 ELSE 0 END AS pred, CASE WHEN label = 1 THEN 'fn' ELSE 'fp' END AS error_type FROM b WHERE (s12 >= 4800000) <> (label = 1)""")
def error_samples(spark, sf):
    """Samples that the mean of all models gets wrong at 0.4."""
    b = X.views(spark, sf).groupBy("sample_id", "label").agg(F.sum("s4").alias("s12")).withColumn("prob", F.col("s12") / 12000000.0)
    return results.errors(b, threshold=0.4).drop("prob")


@query(f"""WITH {X.VIEWS_SQL}, c AS (SELECT sample_id, label, model, s4, CASE WHEN label = 1 AND s4 >= 1600000 THEN 'tp' WHEN label = 1 THEN 'fn' WHEN s4 >= 1600000 THEN 'fp' END AS case_type FROM v)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model, case_type ORDER BY s4 DESC, sample_id) AS r FROM c WHERE case_type IS NOT NULL) WHERE r <= 5""")
def top_cases(spark, sf):
    return results.top_cases(X.views(spark, sf), 0.4, ">=", 5, ["model"]).select("sample_id", "label", "model", "s4", "case_type")


@query(f"""WITH {X.VIEWS_SQL} SELECT sample_id, label, model, CASE WHEN s4 >= 2000000 THEN 1 ELSE 0 END AS pred, round(greatest(s4, 4000000 - s4) / 4000000.0::DOUBLE, 9) AS confidence,
round(-ln(greatest(least(CASE WHEN label = 1 THEN s4 / 4000000.0::DOUBLE ELSE 1 - s4 / 4000000.0::DOUBLE END, 1 - CAST(1e-7 AS DOUBLE)), CAST(1e-7 AS DOUBLE))), 6) AS loss, (s4 >= 2000000) = (label = 1) AS is_correct FROM v""")
def enriched_predictions(spark, sf):
    out = results.enrich_predictions(X.views(spark, sf))
    return out.select("sample_id", "label", "model", "pred", F.round("confidence", 9).alias("confidence"), F.round("loss", 6).alias("loss"), "is_correct")


@query(f"""WITH {X.VIEWS_SQL} SELECT sample_id, m_0 AS s4_a, m_1 AS s4_b FROM w WHERE (m_0 >= 1600000) <> (m_1 >= 1600000)""")
def compare_decisions(spark, sf):
    v = X.views(spark, sf)
    out = ensemble.compare_decisions(v.where("model = 0"), v.where("model = 1"), 0.4)
    return out.select("sample_id", F.round(F.col("prob_a") * 4000000).cast("long").alias("s4_a"), F.round(F.col("prob_b") * 4000000).cast("long").alias("s4_b"))


@query(f"""WITH {X.VIEWS_SQL} SELECT count(*) AS n, round(max(abs(m_0 - m_1)) / 4000000.0::DOUBLE, 9) AS max_drift, round(avg(abs(m_0 - m_1)) / 4000000.0::DOUBLE, 9) AS mean_drift FROM w""")
def score_drift(spark, sf):
    v = X.views(spark, sf)
    return rounded(ensemble.score_drift(v.where("model = 0"), v.where("model = 1")), "max_drift", "mean_drift")


# -- duplicates and groups -------------------------------------------------------------------------

_LONG = """kinds AS (SELECT node, label, pool, 'exact_sha256' AS duplicate_type, exact_sha256 AS hash FROM nodes UNION ALL SELECT node, label, pool, 'ahash64', ahash64 FROM nodes
  UNION ALL SELECT node, label, pool, 'dhash64', dhash64 FROM nodes), long AS (SELECT * FROM kinds WHERE hash IS NOT NULL)"""


def _buckets(kind: str):
    sql = f"WITH {X.NODES_SQL} SELECT {kind} AS hash, count(*) AS n, min(node) AS first_node FROM nodes WHERE {kind} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"

    def run(spark, sf):
        return (
            X.nodes(spark, sf).where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("hash")).agg(F.count("*").alias("n"), F.min("node").alias("first_node")).where("n > 1")
        )

    return sql, run


for _name, _kind in (("exact_duplicates", "exact_sha256"), ("ahash_buckets", "ahash64"), ("dhash_buckets", "dhash64")):
    ORACLE_SQL[_name], QUERIES[_name] = _buckets(_kind)


_REPORT = f"""{X.NODES_SQL}, {_LONG}, tagged AS (SELECT *, CASE WHEN pool = 'test' THEN 'test' WHEN node % 5 = 0 THEN 'generated_val' ELSE 'generated_train' END AS split FROM long),
report AS (SELECT duplicate_type, hash, count(*) AS count, array_to_string(list_sort(list(DISTINCT split)), '|') AS splits, array_to_string(list_sort(list(node)), '|') AS members,
  count(*) FILTER (WHERE split <> 'test') AS train_members, bool_or(split = 'generated_train') AND bool_or(split = 'generated_val') AS train_val_leakage_risk,
  bool_or(split <> 'test') AND bool_or(split = 'test') AS train_test_leakage_risk FROM tagged GROUP BY duplicate_type, hash HAVING count(*) > 1)"""


def _report(spark, sf):
    n = X.nodes(spark, sf)
    train = n.where("pool = 'train'").select("node")
    tagged = duplicates.tag_split(n, train.where("node % 5 <> 0"), train.where("node % 5 = 0"), "node")
    return duplicates.duplicate_report(tagged, "node", X.HASHES).withColumns({"splits": F.array_join("splits", "|"), "members": F.array_join("members", "|")})


@query(f"WITH {_REPORT} SELECT * FROM report")
def duplicate_report(spark, sf):
    return _report(spark, sf)


@query(f"WITH {_REPORT} SELECT duplicate_type, hash, count, train_test_leakage_risk FROM report WHERE train_test_leakage_risk")
def leakage_flags(spark, sf):
    return duplicates.leakage_rows(_report(spark, sf)).select("duplicate_type", "hash", "count", "train_test_leakage_risk")


_GROUPS = f"""RECURSIVE {X.NODES_SQL}, {_LONG}, low AS (SELECT duplicate_type, hash, min(node) AS b FROM long GROUP BY 1, 2 HAVING count(*) > 1),
star AS (SELECT DISTINCT node AS a, b FROM long JOIN low USING (duplicate_type, hash) WHERE node <> b), edges AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS node, min(b) AS group_id FROM reach GROUP BY a), grouped AS (SELECT n.node, n.label, n.exact_sha256, c.group_id FROM nodes n JOIN comp c USING (node))"""


def _grouped(spark, sf):
    n = X.nodes(spark, sf)
    groups = duplicates.components(n, duplicates.evidence_edges(n, "node", X.HASHES), "node")
    return n.select("node", "label", "exact_sha256").join(groups, "node")


@query(f"WITH {_GROUPS} SELECT node, group_id FROM comp")
def duplicate_components(spark, sf):
    """Groups over all duplicate evidence; the id is the smallest member."""
    n = X.nodes(spark, sf)
    return duplicates.components(n, duplicates.evidence_edges(n, "node", X.HASHES), "node")


@query(f"WITH {_GROUPS}, n AS (SELECT group_id, count(*) AS size FROM comp GROUP BY 1) SELECT size, count(*) AS groups FROM n GROUP BY size")
def group_sizes(spark, sf):
    return duplicates.group_sizes(duplicate_components(spark, sf))


@query(f"WITH {_GROUPS}, n AS (SELECT group_id, count(*) AS size FROM comp GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (WHERE size = 1) AS singletons, count(*) FILTER (WHERE size > 1) AS non_singletons, max(size) AS largest FROM n")
def group_summary(spark, sf):
    return duplicates.group_summary(duplicate_components(spark, sf))


@query(f"WITH {_GROUPS} SELECT group_id, count(*) AS size FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_groups(spark, sf):
    return duplicates.top_groups(duplicate_components(spark, sf), "group_id", 10)


@query(f"WITH {_GROUPS} SELECT group_id, count(*) AS size, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives FROM grouped GROUP BY 1 HAVING count(*) FILTER (WHERE label = 0) > 0 AND count(*) FILTER (WHERE label = 1) > 0")
def mixed_label_groups(spark, sf):
    return duplicates.mixed_label_groups(_grouped(spark, sf))


_STRICT = f"""{_GROUPS}, ex AS (SELECT exact_sha256, min(node) AS exact_id FROM grouped GROUP BY 1 HAVING count(*) > 1), sz AS (SELECT group_id, count(*) AS group_size FROM grouped GROUP BY 1),
strict AS (SELECT node, group_id, group_size, CASE WHEN group_size > 4 THEN 'split_large' WHEN group_size BETWEEN 3 AND 4 THEN 'audit_keep' ELSE 'keep' END AS policy,
  CASE WHEN group_size <= 4 THEN 'group_' || group_id WHEN exact_id IS NOT NULL THEN 'exact_' || exact_id ELSE 'single_' || node END AS strict_group_id, group_size BETWEEN 3 AND 4 AS audit_flag
  FROM grouped JOIN sz USING (group_id) LEFT JOIN ex USING (exact_sha256))"""


def _strict(spark, sf):
    g = _grouped(spark, sf)
    return duplicates.strict_groups(g.select("node", "group_id"), duplicates.exact_groups(g, "node", "exact_sha256"), "node", large=4, audit=(3, 4))


@query(f"WITH {_STRICT} SELECT * FROM strict")
def strict_groups(spark, sf):
    return _strict(spark, sf)


@query(f"WITH {_STRICT} SELECT policy, count(*) AS rows, count(DISTINCT strict_group_id) AS groups FROM strict GROUP BY policy")
def policy_counts(spark, sf):
    return duplicates.policy_counts(_strict(spark, sf))


# -- splits ----------------------------------------------------------------------------------------

_HASH = "md5('42:' || CAST({} AS VARCHAR))"
_SIDES = f"""{X.SAMPLES_SQL}, hg AS (SELECT group_id, row_number() OVER (ORDER BY {_HASH.format('group_id')}) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM samples)),
gh AS (SELECT sample_id, label, samples.group_id, CASE WHEN r < greatest(round(CAST(0.2 AS DOUBLE) * n), 1) THEN 'val' ELSE 'train' END AS split FROM samples JOIN hg USING (group_id))"""


def _sample_rows(spark, sf):
    return X.samples(spark, sf).select("sample_id", "label", "group_id")


@query(f"""WITH {X.SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT sample_id, label, group_id, CASE WHEN k < round(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_holdout(spark, sf):
    return splits.stratified_holdout(_sample_rows(spark, sf), 0.2)


@query(f"WITH {_SIDES} SELECT * FROM gh")
def group_holdout(spark, sf):
    return splits.group_holdout(_sample_rows(spark, sf), "group_id", 0.2)


@query(f"""WITH {X.SAMPLES_SQL} SELECT sample_id, label, group_id, CAST((row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) - 1) % 5 AS INTEGER) AS fold FROM samples""")
def stratified_kfold(spark, sf):
    return splits.stratified_kfold(_sample_rows(spark, sf), 5)


_SGK = f"""RECURSIVE {X.SAMPLES_SQL}, gs AS (SELECT group_id, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM samples GROUP BY 1),
every AS (SELECT sum(n0) AS t0, sum(n1) AS t1 FROM gs), sig AS (SELECT n0, n1, count(*) AS c FROM gs GROUP BY 1, 2),
line AS (SELECT *, row_number() OVER (ORDER BY n0 * t1 + n1 * t0 DESC, n1 DESC, n0 DESC) AS i FROM sig, every),
greedy AS (SELECT CAST(0 AS BIGINT) AS i, [0::HUGEINT, 0, 0, 0, 0] AS h0, [0::HUGEINT, 0, 0, 0, 0] AS h1, CAST([] AS BIGINT[]) AS rest
  UNION ALL SELECT i, list_transform(range(1, 6), lambda f: h0[f] + CASE WHEN list_contains(rest, f) THEN n0 ELSE 0 END),
    list_transform(range(1, 6), lambda f: h1[f] + CASE WHEN list_contains(rest, f) THEN n1 ELSE 0 END), rest
  FROM (SELECT line.i, n0, n1, h0, h1, list_transform(list_slice(list_sort(list_transform(range(1, 6),
      lambda f: {{'adds': h0[f] * n0 * t1 * t1 + h1[f] * n1 * t0 * t0, 'load': h0[f] * t1 + h1[f] * t0, 'f': f}})), 1, c % 5), lambda x: x.f) AS rest
    FROM greedy JOIN line ON line.i = greedy.i + 1)),
gr AS (SELECT group_id, line.i, c, row_number() OVER (PARTITION BY gs.n0, gs.n1 ORDER BY {_HASH.format('group_id')}) - 1 AS r FROM gs JOIN line ON line.n0 = gs.n0 AND line.n1 = gs.n1),
gf AS (SELECT group_id, CAST(CASE WHEN r < (c // 5) * 5 THEN r % 5 ELSE rest[r - (c // 5) * 5 + 1] - 1 END AS INTEGER) AS fold FROM gr JOIN greedy ON greedy.i = gr.i),
sgk AS (SELECT sample_id, label, samples.group_id, gf.fold FROM samples JOIN gf USING (group_id)),
fg AS (SELECT fold, group_id, count(*) AS n, count(*) FILTER (WHERE label = 1) AS p FROM sgk GROUP BY 1, 2),
dist AS (SELECT fold, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - sum(p) AS BIGINT) AS negatives, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(p) AS DOUBLE) / sum(n) AS positive_ratio, count(*) AS groups, max(n) AS largest_group FROM fg GROUP BY fold)"""


@query(f"WITH {_SGK} SELECT * FROM sgk")
def stratified_group_kfold(spark, sf):
    return splits.stratified_group_kfold(_sample_rows(spark, sf), "group_id")


@query(f"""WITH {_SGK}, many AS (SELECT group_id FROM fg GROUP BY 1 HAVING count(*) > 1), sh AS (SELECT fold, count(*) AS s FROM fg WHERE group_id IN (SELECT group_id FROM many) GROUP BY 1)
SELECT dist.*, coalesce(s, 0) AS shared_groups FROM dist LEFT JOIN sh USING (fold)""")
def fold_distribution(spark, sf):
    return splits.fold_distribution(stratified_group_kfold(spark, sf))


@query(f"""WITH {_SGK}, t AS (SELECT sum(n) AS tn, sum(positives) AS tp FROM dist)
SELECT fold, n, round(2 * abs(positive_ratio - CAST(tp AS DOUBLE) / tn), 9) AS ratio_error, round(abs(CAST(n AS DOUBLE) / tn - CAST(0.2 AS DOUBLE)), 9) AS size_error,
round(2 * abs(positive_ratio - CAST(tp AS DOUBLE) / tn) + abs(CAST(n AS DOUBLE) / tn - CAST(0.2 AS DOUBLE)) + CAST(0.01 AS DOUBLE) * largest_group / tn, 9) AS score FROM dist, t""")
def fold_scores(spark, sf):
    return rounded(splits.fold_scores(stratified_group_kfold(spark, sf), 5, "group_id", size_penalty=0.01), "ratio_error", "size_error", "score")


_VERIFY = """k AS (SELECT sample_id, count(*) AS n, count(DISTINCT split) AS s FROM rows GROUP BY 1), g AS (SELECT group_id, count(DISTINCT split) AS s FROM rows GROUP BY 1),
c AS (SELECT (SELECT count(*) FROM k WHERE s > 1) AS key_overlap, (SELECT count(DISTINCT sample_id) FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM k)) AS missing,
  (SELECT count(*) FROM k WHERE sample_id NOT IN (SELECT sample_id FROM samples)) AS extra, (SELECT count(*) FROM k WHERE n > 1) AS assigned_repeatedly, (SELECT count(*) FROM g WHERE s > 1) AS group_overlap)
SELECT *, key_overlap + missing + extra + assigned_repeatedly + group_overlap = 0 AS passes FROM c"""


@query(f"WITH {_SIDES}, rows AS (SELECT * FROM gh), {_VERIFY}")
def split_verification(spark, sf):
    return splits.verify_split(group_holdout(spark, sf), _sample_rows(spark, sf), "sample_id", "group_id")


@query(f"""WITH {_SIDES}, rows AS (SELECT * FROM gh WHERE sample_id % 97 <> 0 UNION ALL SELECT sample_id, label, group_id, CASE split WHEN 'val' THEN 'train' ELSE 'val' END FROM gh WHERE sample_id % 89 = 0 AND sample_id % 97 <> 0
UNION ALL SELECT * FROM gh WHERE sample_id % 83 = 0 AND sample_id % 97 <> 0 UNION ALL SELECT -sample_id, label, group_id, split FROM gh WHERE sample_id % 79 = 0), {_VERIFY}""")
def split_faults(spark, sf):
    """The proof over a split with planted faults: rows left out, on both sides, repeated, and invented."""
    h = group_holdout(spark, sf).select("sample_id", "label", "group_id", "split")
    kept = h.where("sample_id % 97 <> 0")
    other = kept.where("sample_id % 89 = 0").withColumn("split", F.when(F.col("split") == "val", "train").otherwise("val"))
    invented = h.where("sample_id % 79 = 0").withColumn("sample_id", -F.col("sample_id"))
    return splits.verify_split(kept.union(other).union(kept.where("sample_id % 83 = 0")).union(invented), _sample_rows(spark, sf), "sample_id", "group_id")


@query(f"""WITH {X.SAMPLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM samples),
h AS (SELECT group_id, CASE WHEN k < round(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS split FROM r) SELECT group_id, count(DISTINCT split) AS sides FROM h GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_overlap(spark, sf):
    """Groups that a split by samples tears apart."""
    return splits.split_overlap(stratified_holdout(spark, sf), "split", "group_id")


@query(f"""WITH {X.SAMPLES_SQL}, r AS (SELECT *, {_HASH.format('sample_id')} AS h, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) AS k FROM samples)
SELECT sample_id, label, group_id FROM r WHERE k <= 50 UNION ALL SELECT * FROM (SELECT sample_id, label, group_id FROM r WHERE k > 50 ORDER BY h LIMIT 1)""")
def stratified_sample(spark, sf):
    """A sample of 101 rows: 50 of each label and one more."""
    return splits.stratified_sample(_sample_rows(spark, sf), 101)


_NAMED = f"{X.SAMPLES_SQL}, named AS (SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN 'Case_' || group_id || '_' || sample_id || '.png' WHEN 1 THEN 'dir/patient-' || group_id || '.JPEG' ELSE 'img ' || sample_id END AS file_name FROM samples)"


@query(f"""WITH {_NAMED} SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN 'case_' || CAST((SELECT s.group_id FROM samples s WHERE s.sample_id = named.sample_id) AS VARCHAR) WHEN 1 THEN 'patient-' || CAST((SELECT s.group_id FROM samples s WHERE s.sample_id = named.sample_id) AS VARCHAR) END AS entity, CASE sample_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' ELSE '' END AS suffix FROM named""")
def entity_from_name(spark, sf):
    name = F.col("file_name")
    return _named(spark, sf).select("sample_id", C.entity_from_name(name).alias("entity"), C.file_suffix(name).alias("suffix"))


def _named(spark, sf):
    name = (
        F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("Case_"), "group_id", F.lit("_"), "sample_id", F.lit(".png")))
        .when(F.col("sample_id") % 3 == 1, F.concat(F.lit("dir/patient-"), "group_id", F.lit(".JPEG")))
        .otherwise(F.concat(F.lit("img "), "sample_id"))
    )
    return X.samples(spark, sf).select("sample_id", name.alias("file_name"))


# -- pseudo-labels and submissions --------------------------------------------------------------------

_BLEND = f"{X.VIEWS_SQL}, b AS (SELECT sample_id, label, CAST(m_0 + m_1 + m_2 AS BIGINT) AS s12 FROM w)"


def _blended(spark, sf):
    b = X.views(spark, sf).groupBy("sample_id", "label").agg(F.sum("s4").alias("s12"))
    return b.withColumn("prob", F.col("s12") / 12000000.0)


@query(f"""WITH {_BLEND} SELECT sample_id, CASE WHEN s12 >= 10800000 THEN 1 ELSE 0 END AS label, round(greatest(s12, 12000000 - s12) / 12000000.0::DOUBLE, 9) AS pseudo_confidence, CAST(0.35 AS DOUBLE) AS sample_weight, 'pseudo_' || sample_id AS group_id FROM b WHERE s12 <= 1200000 OR s12 >= 10800000""")
def pseudo_labels(spark, sf):
    return rounded(ensemble.pseudo_labels(_blended(spark, sf), 0.1, 0.9), "pseudo_confidence").drop("prob")


@query(f"""WITH {_BLEND} SELECT sample_id, CASE WHEN s12 >= 11400000 THEN 1 ELSE 0 END AS label, round(greatest(s12, 12000000 - s12) / 12000000.0::DOUBLE, 9) AS pseudo_confidence FROM b WHERE s12 < 600000 OR s12 > 11400000
ORDER BY round(greatest(s12, 12000000 - s12) / 12000000.0::DOUBLE, 9) DESC, sample_id LIMIT 100""")
def pseudo_confidence_cap(spark, sf):
    rows = ensemble.pseudo_labels(_blended(spark, sf), 0.05, 0.95, inclusive=False)
    return ensemble.most_confident(rounded(rows, "pseudo_confidence"), 100).select("sample_id", "label", "pseudo_confidence")


@query(f"""WITH {_BLEND}, s AS (SELECT 'before' AS stage, s12 FROM b UNION ALL SELECT 'after', s12 FROM b WHERE s12 <= 1200000 OR s12 >= 10800000), n AS (SELECT stage, least(24, (2 * s12 + 1) // 960000) AS bin, count(*) AS n FROM s GROUP BY 1, 2),
grid AS (SELECT stage, bin FROM (SELECT DISTINCT stage FROM s), (SELECT unnest(range(25)) AS bin)) SELECT stage, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) * 25 / CAST((SELECT count(*) FROM s x WHERE x.stage = grid.stage) AS DOUBLE), 9) AS density FROM grid LEFT JOIN n USING (stage, bin)""")
def prob_shift(spark, sf):
    """Histograms before and after choosing confident rows."""
    b = _blended(spark, sf).withColumn("prob", (2 * F.col("s12") + 1) / 24000000.0)
    return rounded(ensemble.prob_shift(b, b.where("s12 <= 1200000 OR s12 >= 10800000")), "density")


@query(f"""WITH {_BLEND}, t AS (SELECT unnest([350, 400, 450]) AS threshold_milli), tpl AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS row_idx FROM b)
SELECT threshold_milli, row_idx, sample_id, CASE WHEN s12 >= threshold_milli * 12000 THEN 1 ELSE 0 END AS label FROM b JOIN tpl USING (sample_id), t""")
def submission_thresholds(spark, sf):
    return results.submission(_template(spark, sf), _blended(spark, sf), [350, 400, 450])


def _template(spark, sf):
    return splits.ranked(X.samples(spark, sf).select("sample_id").withColumn("_one", F.lit(0)), ["_one"], "sample_id", "row_idx").select("row_idx", "sample_id", F.lit(0).alias("label"))


@query(f"""WITH {_BLEND}, tpl AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS row_idx FROM b),
kept AS (SELECT row_idx, sample_id, CASE WHEN sample_id % 89 = 0 THEN NULL WHEN sample_id % 83 = 0 THEN 2.0::DOUBLE WHEN sample_id % 73 = 0 THEN 0.5::DOUBLE WHEN s12 >= 4800000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM b JOIN tpl USING (sample_id) WHERE sample_id % 97 <> 0),
sub AS (SELECT * FROM kept UNION ALL SELECT row_idx, sample_id, 1.0 FROM kept WHERE sample_id % 79 = 0 UNION ALL (SELECT -1, -1, 1.0 FROM kept LIMIT 1)),
met AS (SELECT t.row_idx AS ti, t.sample_id AS tk, s.row_idx AS si, s.sample_id AS sk, s.label FROM tpl t FULL JOIN sub s ON t.sample_id = s.sample_id),
n AS (SELECT count(*) FILTER (WHERE sk IS NULL) AS missing, count(*) FILTER (WHERE tk IS NULL) AS extra, count(*) FILTER (WHERE ti <> si) AS misplaced, count(*) FILTER (WHERE sk IS NOT NULL AND label IS NULL) AS nulls,
  count(*) FILTER (WHERE label NOT IN (0, 1)) AS out_of_domain, count(*) FILTER (WHERE label <> floor(label)) AS fractional,
  (SELECT count(*) FROM (SELECT sample_id FROM sub GROUP BY sample_id HAVING count(*) > 1)) AS repeated, 0::BIGINT AS wrong_columns FROM met)
SELECT *, missing + extra + misplaced + nulls + out_of_domain + repeated + fractional + wrong_columns = 0 AS valid FROM n""")
def submission_validation(spark, sf):
    """Violations of a result file with planted faults: ids left out, repeated, invented; null, fractional and foreign values."""
    sub = results.submission(_template(spark, sf), _blended(spark, sf)).where("sample_id % 97 <> 0")
    sub = sub.withColumn("label", F.when(F.col("sample_id") % 89 == 0, None).when(F.col("sample_id") % 83 == 0, 2.0).when(F.col("sample_id") % 73 == 0, 0.5).otherwise((F.col("label") >= 0.4).cast("double")))
    again = sub.where("sample_id % 79 = 0").withColumn("label", F.lit(1.0))
    invented = sub.orderBy("sample_id").limit(1).select(F.lit(-1).cast("long").alias("row_idx"), F.lit(-1).cast("long").alias("sample_id"), F.lit(1.0).alias("label"))
    return results.validate_submission(_template(spark, sf), sub.union(again).union(invented))


# -- run logs --------------------------------------------------------------------------------------------

_REPLAY = f"""RECURSIVE {X.RUNS_SQL}, fold AS (
  SELECT run, epoch, cents AS best, epoch AS best_epoch, 0 AS waited, CAST(NULL AS BIGINT) AS stopped FROM logs WHERE epoch = 1
  UNION ALL SELECT l.run, l.epoch, CASE WHEN f.stopped IS NULL AND l.cents > f.best + 100 THEN l.cents ELSE f.best END, CASE WHEN f.stopped IS NULL AND l.cents > f.best + 100 THEN l.epoch ELSE f.best_epoch END,
    CASE WHEN f.stopped IS NOT NULL THEN f.waited WHEN l.cents > f.best + 100 OR l.epoch < 3 THEN 0 ELSE f.waited + 1 END,
    CASE WHEN f.stopped IS NOT NULL THEN f.stopped WHEN NOT (l.cents > f.best + 100 OR l.epoch < 3) AND f.waited + 1 >= 6 THEN l.epoch END
  FROM fold f JOIN logs l ON l.run = f.run AND l.epoch = f.epoch + 1)"""


@query(f"WITH {_REPLAY} SELECT run, best_epoch, CAST(best AS DOUBLE) AS best_value, stopped AS stopped_epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM fold) WHERE r = 1")
def early_stopping_replay(spark, sf):
    return results.early_stopping(X.runs(spark, sf), "run", "epoch", "cents", min_delta=100, patience=6, start_epoch=3)


@query(f"WITH {X.RUNS_SQL} SELECT run, epoch, cents FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY cents DESC, epoch) AS r FROM logs) WHERE r = 1")
def best_epoch(spark, sf):
    return results.best_epoch(X.runs(spark, sf), "run", [F.col("cents").desc_nulls_last(), F.col("epoch")])


@query(f"WITH {X.RUNS_SQL} SELECT run, epoch, cents, r AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY cents DESC, epoch) AS INTEGER) AS r FROM logs) WHERE r <= 3")
def top_epochs(spark, sf):
    return results.top_epochs(X.runs(spark, sf), "run", [F.col("cents").desc_nulls_last(), F.col("epoch")], 3)


@query(f"WITH {X.RUNS_SQL}, m AS (SELECT run, max(cents) AS best, min(cents) AS worst, count(*) AS epochs FROM logs GROUP BY run) SELECT * FROM m ORDER BY best DESC, worst DESC, run LIMIT 20")
def leaderboard(spark, sf):
    m = X.runs(spark, sf).groupBy("run").agg(F.max("cents").alias("best"), F.min("cents").alias("worst"), F.count("*").alias("epochs"))
    return results.leaderboard(m, [F.col("best").desc_nulls_last(), F.col("worst").desc_nulls_last(), F.col("run")], 20)


@query(f"WITH {X.RUNS_SQL} SELECT epoch, round(CAST(sum(cents * (run % 3 + 1)) AS DOUBLE) / sum(run % 3 + 1), 6) AS mean_cents FROM logs GROUP BY epoch")
def weighted_epoch_mean(spark, sf):
    return rounded(metrics.weighted_mean(X.runs(spark, sf).withColumn("weight", F.col("run") % 3 + 1), "cents", "weight", ["epoch"]), "mean_cents", digits=6)


# -- audit -------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT vec_id, label, embedding AS g FROM embeddings),
x AS (SELECT vec_id, label, list_sum([CAST(g[r*8+c+1] AS DOUBLE) for r in range(8) for c in range(8) if r = 0 OR r = 7 OR c = 0 OR c = 7]) / 28 AS border_mean,
  list_sum([CAST(g[r*8+c+1] AS DOUBLE) for r in range(8) for c in range(8) if (r = 0 OR r = 7) AND (c = 0 OR c = 7)]) / 4 AS corner_mean FROM g)
SELECT label, count(*) AS n, round(avg(border_mean), 6) AS border_mean, round(avg(corner_mean), 6) AS corner_mean FROM x GROUP BY label""".replace(
    "[CAST(g[r*8+c+1] AS DOUBLE) for r in range(8) for c in range(8) if r = 0 OR r = 7 OR c = 0 OR c = 7]", "[CAST(g[k+1] AS DOUBLE) for k in range(64) if k // 8 IN (0, 7) OR k % 8 IN (0, 7)]"
).replace("[CAST(g[r*8+c+1] AS DOUBLE) for r in range(8) for c in range(8) if (r = 0 OR r = 7) AND (c = 0 OR c = 7)]", "[CAST(g[k+1] AS DOUBLE) for k in range(64) if k // 8 IN (0, 7) AND k % 8 IN (0, 7)]"))
def grid_border_corner_means(spark, sf):
    """Border and corner means of 8 x 8 grids by label, in plain expressions."""
    from tallyframe.sources.images import grid_mean

    e = X.table(spark, sf, "embeddings")
    rows = e.select("label", grid_mean(F.col("embedding"), 8, 8, "border").alias("b"), grid_mean(F.col("embedding"), 8, 8, "corner").alias("c"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("b").alias("border_mean"), F.avg("c").alias("corner_mean")), "border_mean", "corner_mean", digits=6)


@query(f"""WITH {X.SAMPLES_SQL}, x AS (SELECT label, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM samples JOIN orders ON o_orderkey = sample_id),
b AS (SELECT label, count(*) AS n, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.75) AS q3 FROM x GROUP BY label)
SELECT 'cents' AS "column", b.label, n, CAST(min(cents) AS DOUBLE) AS low, round(any_value(q1), 3) AS q1, round(any_value(median), 3) AS median, round(any_value(q3), 3) AS q3, CAST(max(cents) AS DOUBLE) AS high
FROM b JOIN x ON x.label = b.label AND cents >= q1 - 1.5 * (q3 - q1) AND cents <= q3 + 1.5 * (q3 - q1) GROUP BY b.label, n""")
def numeric_by_label(spark, sf):
    s = X.samples(spark, sf).join(X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")), "sample_id")
    return rounded(metrics.numeric_by_label(s, ["cents"], exact=True), "q1", "median", "q3", digits=3)


def _empty(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((1 - F.count("*")).alias("n"))


@query(f"""WITH {_REPORT}, {_SIDES}, checks AS (
  SELECT 'documents without text' AS item, (SELECT count(*) FROM documents WHERE text IS NULL OR text = '') AS evidence, 'drop or refetch' AS act
  UNION ALL SELECT 'labels outside the domain', (SELECT count(*) FROM labels WHERE quality IS NULL OR quality NOT IN (0, 1)), 'correct the labels'
  UNION ALL SELECT 'labels without document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)), 'drop the labels'
  UNION ALL SELECT 'repeated document ids', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)), 'make ids unique'
  UNION ALL SELECT 'duplicates across train and test', (SELECT count(*) FROM report WHERE train_test_leakage_risk), 'split by groups'
  UNION ALL SELECT 'duplicates across train and validation', (SELECT count(*) FROM report WHERE train_val_leakage_risk), 'split by groups'
  UNION ALL SELECT 'tables without rows', (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM documents) + (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM labels), 'load the tables'
  UNION ALL SELECT 'near-duplicates by grid hashes', (SELECT count(*) FROM report WHERE duplicate_type <> 'exact_sha256'), 'review the groups'
  UNION ALL SELECT 'groups on both sides of the split', (SELECT count(*) FROM (SELECT group_id FROM gh GROUP BY 1 HAVING count(DISTINCT split) > 1)), 'split by groups'
  UNION ALL SELECT 'majority class of 70 %', (SELECT CASE WHEN max(n) >= CAST(0.7 AS DOUBLE) * sum(n) THEN 1 ELSE 0 END FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)), 'weight the classes')
SELECT item, CASE WHEN evidence > 0 THEN 'WARN' ELSE 'PASS' END AS status, CAST(evidence AS BIGINT) AS evidence, CASE WHEN evidence > 0 THEN act ELSE 'none' END AS action FROM checks""")
def risk_checklist(spark, sf):
    docs, labels, report = X.table(spark, sf, "documents"), X.table(spark, sf, "labels"), _report(spark, sf)
    n = lambda df, cond: df.agg(F.count_if(cond).alias("n"))
    balance = metrics.class_balance(labels, "quality").agg(F.max(F.col("imbalanced").cast("int")).alias("n"))
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("k"))
    return results.risk_checklist([
        ("documents without text", n(docs, F.coalesce(F.col("text"), F.lit("")) == ""), "drop or refetch"),
        ("labels outside the domain", n(labels, F.col("quality").isNull() | ~F.col("quality").isin(0, 1)), "correct the labels"),
        ("labels without document", n(results.missing(labels, docs, "doc_id"), F.lit(True)), "drop the labels"),
        ("repeated document ids", n(repeated, F.col("k") > 1), "make ids unique"),
        ("duplicates across train and test", n(report, F.col("train_test_leakage_risk")), "split by groups"),
        ("duplicates across train and validation", n(report, F.col("train_val_leakage_risk")), "split by groups"),
        ("tables without rows", _empty(docs).crossJoin(_empty(labels).withColumnRenamed("n", "m")).select((F.col("n") + F.col("m")).alias("n")), "load the tables"),
        ("near-duplicates by grid hashes", n(report, F.col("duplicate_type") != "exact_sha256"), "review the groups"),
        ("groups on both sides of the split", n(splits.split_overlap(group_holdout(spark, sf), "split", "group_id"), F.lit(True)), "split by groups"),
        ("majority class of 70 %", balance, "weight the classes"),
    ])


@query("""WITH px AS (SELECT vec_id, label, [least(255, greatest(0, CAST(floor(CAST(x AS DOUBLE) * 40 + 128) AS BIGINT))) for x in embedding] AS g FROM embeddings)
SELECT vec_id, 8 AS width, 8 AS height, 1 AS channels, round(list_sum(g) / 64.0::DOUBLE, 6) AS mean, round(sqrt(list_sum([(x - list_sum(g) / 64.0::DOUBLE) * (x - list_sum(g) / 64.0::DOUBLE) for x in g]) / 64), 6) AS std,
CAST(list_min(g) AS DOUBLE) AS min, CAST(list_max(g) AS DOUBLE) AS max, round(list_sum([g[k+1] for k in range(64) if k // 8 IN (0, 7) OR k % 8 IN (0, 7)]) / 28.0::DOUBLE, 6) AS border_mean,
round((g[1] + g[8] + g[57] + g[64]) / 4.0::DOUBLE, 6) AS corner_mean, 1.0::DOUBLE AS aspect_ratio, true AS readable FROM px""")
def image_metadata(spark, sf):
    """Size and intensity statistics of the embeddings read as 8 x 8 gray images."""
    from tallyframe.sources.images import image_metadata as stats

    e = X.table(spark, sf, "embeddings")
    pixel = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 40 + 128))).cast("int"))
    data = F.unhex(F.array_join(F.transform(pixel, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    images = e.select("vec_id", F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))
    out = stats(images, ["vec_id"]).select("vec_id", "width", "height", "channels", "mean", "std", "min", "max", "border_mean", "corner_mean", "aspect_ratio", "readable")
    return rounded(out, "mean", "std", "border_mean", "corner_mean", digits=6)


@query("""WITH px AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings)
SELECT label, pos // 8 AS row, pos % 8 AS col, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM px GROUP BY 1, 2, 3""")
def mean_grid_by_label(spark, sf):
    from tallyframe.sources.images import mean_grid_by_label as grids

    return rounded(grids(X.table(spark, sf, "embeddings"), "embedding", 8, "label"), "mean", digits=6)
