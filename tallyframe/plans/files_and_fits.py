"""Registered queries over files that they write from the given tables, and over fitted weights, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import duplicates, ensemble, metrics, results
from tallyframe.plans import fixtures as X
from tallyframe.plans.registry import QUERIES, _BLEND, _LONG, _blended, _grid, _REPORT, _template, query, rounded
from tallyframe.sources import tables

# -- the stacker ----------------------------------------------------------------------------------------

_TERMS = (*X.MODELS, len(X.MODELS))  # the last one is the intercept
_ROUNDS = 25


def _solved() -> str:
    """SELECT r, w*, d*: Newton's step from sums h<i><j> (upper half) and g<i>, by elimination, one subquery a column."""
    last = _TERMS[-1]
    text = "sums"
    for k in _TERMS[:-1]:
        below = [i for i in _TERMS if i > k]
        kept = ["r", *(f"w{i}" for i in _TERMS), *(f"h{i}{j}" for i in _TERMS if i <= k for j in _TERMS if j >= i), *(f"g{i}" for i in _TERMS if i <= k)]
        made = [f"h{i}{j} - h{k}{i} * h{k}{j} / h{k}{k} AS h{i}{j}" for i in below for j in below if j >= i] + [f"g{i} - h{k}{i} * g{k} / h{k}{k} AS g{i}" for i in below]
        text = f"(SELECT {', '.join(kept + made)} FROM {text})"
    for k in reversed(_TERMS):
        known = "".join(f" - h{k}{j} * d{j}" for j in range(k + 1, last + 1))
        text = f"(SELECT *, (g{k}{known}) / h{k}{k} AS d{k} FROM {text})"
    return text


def _stacked_sql() -> str:
    last = _TERMS[-1]
    z = " + ".join(f"w{i} * x{i}" for i in _TERMS)
    p = f"(1 / (1 + exp(-({z}))))"
    ridge = lambda i, value: "" if i == last else f" + {value}"
    firsts = [f"sum(({p} - label) * x{i}){ridge(i, f'2 * w{i}')} AS g{i}" for i in _TERMS]
    seconds = [f"sum({p} * (1 - {p}) * x{i} * x{j}){ridge(i, '2') if i == j else ''} AS h{i}{j}" for i in _TERMS for j in _TERMS if j >= i]
    names = ", ".join(f"w{i}" for i in _TERMS)
    sums = f"(SELECT r, {names}, {', '.join(firsts + seconds)} FROM fit, z WHERE r < {_ROUNDS} GROUP BY r, {names})"
    step = f"SELECT r + 1, {', '.join(f'w{i} - d{i}' for i in _TERMS)} FROM {_solved().replace('FROM sums', f'FROM {sums}')}"
    scale = ", ".join(f"avg(m_{m} / 4000000.0::DOUBLE) AS a{m}, stddev_pop(m_{m} / 4000000.0::DOUBLE) AS s{m}" for m in X.MODELS)
    xs = ", ".join(f"(m_{m} / 4000000.0::DOUBLE - a{m}) / s{m} AS x{m}" for m in X.MODELS)
    return f"""WITH RECURSIVE {X.VIEWS_SQL}, scale AS (SELECT {scale} FROM w), z AS MATERIALIZED (SELECT sample_id, label, {xs}, 1.0::DOUBLE AS x{last} FROM w, scale),
fit AS (SELECT 0 AS r, {', '.join(f'0.0::DOUBLE AS w{i}' for i in _TERMS)} UNION ALL {step}), done AS (SELECT * FROM fit WHERE r = {_ROUNDS})"""


def _stack(spark, sf):
    wide = tables.materialize(ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="prob"), "stacked")
    return ensemble.fit_stacker(wide, X.MODELS), wide


@query(f"{_stacked_sql()} SELECT sample_id, label, round(1 / (1 + exp(-({' + '.join(f'w{i} * x{i}' for i in _TERMS)}))), 6) AS prob FROM z, done")
def stacking_logistic(spark, sf):
    """Probabilities of the logistic stacker, fitted by Newton's method in sums over all rows."""
    stacker, wide = _stack(spark, sf)
    return stacker.transform(wide).select("sample_id", "label", F.round("prob", 6).alias("prob"))


@query(" UNION ALL ".join(f"{_stacked_sql() + ' ' if i == 0 else ''}SELECT '{'intercept' if i == _TERMS[-1] else f'm_{i}'}' AS term, round(w{i}, 5) AS value FROM done" for i in _TERMS))
def stacker_coefficients(spark, sf):
    return rounded(_stack(spark, sf)[0].table(spark), "value", digits=5)


# -- the lines through the grid's winner -------------------------------------------------------------------


def _lines_sql() -> str:
    parts = []
    for m in X.MODELS:
        a, b = (o for o in X.MODELS if o != m)
        parts.append(f"""SELECT label, '{m}' AS model, w_{m} * m_{m} + w_{a} * m_{a} + w_{b} * m_{b} >= 20 * cut AS at_start, m_{m} AS own, cut,
CASE WHEN w_{a} + w_{b} = 0 THEN 2 ELSE w_{a} + w_{b} END AS share, CASE WHEN w_{a} + w_{b} = 0 THEN m_{a} + m_{b} ELSE w_{a} * m_{a} + w_{b} * m_{b} END AS others FROM w, winner""")
    return f"""WITH {X.VIEWS_SQL}, {_grid(50, 950, 1)}, winner AS (SELECT weight_id // 441 AS w_0, weight_id // 21 % 21 AS w_1, weight_id % 21 AS w_2, cut * 4000 AS cut FROM c
  WHERE slot >= 0 ORDER BY tn + tp DESC, weight_id, cut LIMIT 1),
lines AS (SELECT label, model, at_start, cut * share - others AS num, own * share - others AS den FROM ({' UNION ALL '.join(parts)})),
base AS (SELECT model, count(*) FILTER (WHERE (label = 1) = (num < 0 OR (num = 0 AND den >= 0))) AS base, count(*) FILTER (WHERE (label = 1) = at_start) AS start_right FROM lines GROUP BY model),
crossings AS (SELECT model, CAST(num AS DOUBLE) / CAST(den AS DOUBLE) AS t, sum(CASE WHEN (label = 1) = (den > 0) THEN 1 ELSE -1 END) AS gain FROM lines WHERE den <> 0 GROUP BY 1, 2),
cells AS (SELECT model, t, CAST(base + sum(gain) OVER (PARTITION BY model ORDER BY t) AS BIGINT) AS "right" FROM crossings JOIN base USING (model) WHERE t > 0 AND t < 1
  UNION ALL SELECT model, 0.0::DOUBLE, base FROM base),
placed AS (SELECT *, lead(t, 1, 1.0::DOUBLE) OVER (PARTITION BY model ORDER BY t) AS t_hi, row_number() OVER (PARTITION BY model ORDER BY "right" DESC, t) AS place FROM cells)
SELECT model, round(t, 12) AS t_lo, round(t_hi, 12) AS t_hi, "right", start_right FROM placed JOIN base USING (model) WHERE place = 1"""


@query(_lines_sql())
def weight_line_search(spark, sf):
    """The grid's winner against every other share of each model, to the exact crossing."""
    wide = tables.materialize(ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4"), "lines")
    grid = ensemble.simplex_grid(spark, X.MODELS)
    best = ensemble.grid_search(wide, grid, X.MODELS, 20, 50, 950, 1, scale=4000000).join(grid, "weight_id").first()  # one row
    if best is None:
        return spark.createDataFrame([], "model string, t_lo double, t_hi double, right long, start_right long")
    out = ensemble.line_search(wide, {m: best[f"w_{m}"] for m in X.MODELS}, X.MODELS, best.threshold_milli * 4000)
    return rounded(out, "t_lo", "t_hi", digits=12)


# -- files ------------------------------------------------------------------------------------------------


@query("""SELECT 'region=' || n_regionkey || '/nation=' || n_nationkey AS folder, count(*) AS customers, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def indexed_files(spark, sf):
    """Customer names as text files in nested folders: what the index of the files says, beside the rows read back."""
    root = tables.scratch_path(spark, "names")
    nation = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = X.table(spark, sf, "customer").join(nation, "c_nationkey").select("region", F.col("c_nationkey").alias("nation"), "c_name")
    rows.write.partitionBy("region", "nation").text(root)
    folder = lambda c: F.regexp_extract(c, r"(region=[^/]+/nation=[^/]+)/[^/]+$", 1).alias("folder")
    sizes = tables.file_index(spark, root).groupBy(folder("rel_path")).agg(F.sum("length").alias("bytes"))
    lines = spark.read.option("recursiveFileLookup", True).text(root).groupBy(folder("_metadata.file_path")).agg(F.count("*").alias("customers"))
    return lines.join(sizes, "folder").select("folder", "customers", "bytes")


#: Column names of each model's file, and its place below the root, as different training runs leave them.
_FILES = {0: (("image_id", "pred_prob", "true_label"), "oof_0.csv"), 1: (("file_name", "probability", "label"), "runs/oof_1"), 2: (("id", "prediction", "target"), "oof_2.csv")}


@query(f"WITH {X.VIEWS_SQL} SELECT CAST(sample_id AS VARCHAR) AS sample_id, label, CAST(model AS VARCHAR) AS model, round(s4 / 4000000.0::DOUBLE, 9) AS prob FROM v")
def discovered_predictions(spark, sf):
    """Three models' files, of unlike names and columns, found and read as one table."""
    root = tables.scratch_path(spark, "predictions")
    v = tables.materialize(X.views(spark, sf), "views")
    for m, (names, place) in _FILES.items():
        v.where(F.col("model") == m).select(F.col("sample_id").alias(names[0]), F.col("prob").alias(names[1]), F.col("label").alias(names[2])).write.csv(f"{root}/{place}", header=True)
    found = tables.discover_predictions(spark, root, {str(m): [f"missing_{m}.csv", place] for m, (_, place) in _FILES.items()})
    return rounded(found, "prob")


@query(f"WITH {X.RUNS_SQL} SELECT 'run=' || run % 16 AS run, count(*) AS epochs, max(epoch) AS last_epoch, CAST(sum(cents) AS BIGINT) AS cents FROM logs GROUP BY 1")
def logs_read_back(spark, sf):
    """Run logs as CSV files, a folder each, with the run's name taken from the path."""
    root = tables.scratch_path(spark, "logs")
    logs = X.runs(spark, sf).withColumnsRenamed({"run": "user"}).withColumn("run", F.col("user") % 16)
    logs.write.partitionBy("run").csv(root, header=True)
    back = tables.read_runs(spark, f"{root}/*", "user long, epoch long, cents long")
    return back.groupBy("run").agg(F.count("*").alias("epochs"), F.max("epoch").alias("last_epoch"), F.sum("cents").alias("cents"))


@query(f"""WITH {_BLEND} SELECT row_number() OVER (ORDER BY sample_id) - 1 AS position, sample_id, CASE WHEN s12 >= 4800000 THEN 1 ELSE 0 END AS label FROM b""")
def ordered_submission(spark, sf):
    """A result file of many parts: each row's place, as part numbers and row indexes give it, is its place in the template."""
    path = tables.scratch_path(spark, "submission")
    tables.write_ordered(results.submission(_template(spark, sf), _blended(spark, sf), [400]), path, ["row_idx"])
    return tables.read_ordered(spark, path).select("position", "sample_id", "label")


@query(f"""WITH {X.VIEWS_SQL}, board AS (SELECT model FROM v GROUP BY model ORDER BY count(*) FILTER (WHERE (s4 >= 1600000) = (label = 1)) DESC, model LIMIT 1)
SELECT sample_id, CASE WHEN s4 >= 1600000 THEN 1 ELSE 0 END AS label FROM v JOIN board USING (model)""")
def promoted_submission(spark, sf):
    """Every model's result files, of which the most accurate model's are promoted, byte by byte, and read back."""
    root = tables.scratch_path(spark, "candidates")
    v = tables.materialize(X.views(spark, sf), "views")
    v.select("model", "sample_id", (F.col("s4") >= 1600000).cast("int").alias("label")).write.partitionBy("model").csv(root, header=True)
    board = metrics.binary_metrics(v, 0.4, keys=["model"]).select("model", (F.col("tn") + F.col("tp")).alias("right"), F.concat(F.lit(f"{root}/model="), "model").alias("path"))
    board = results.leaderboard(board, [F.col("right").desc(), F.col("model")])
    if board.isEmpty():
        return spark.createDataFrame([], "sample_id long, label int")
    results.promote(board, "path", f"{root}-best")
    return spark.read.schema("sample_id long, label int").csv(f"{root}-best", header=True)


# -- members of duplicate buckets ------------------------------------------------------------------------------


@query(f"WITH {X.NODES_SQL}, {_LONG} SELECT duplicate_type, hash, node AS member FROM long JOIN (SELECT duplicate_type, hash FROM long GROUP BY 1, 2 HAVING count(*) > 1) USING (duplicate_type, hash)")
def duplicate_members(spark, sf):
    """A row for each member of each bucket; no bucket is gathered."""
    return duplicates.duplicate_members(X.nodes(spark, sf), "node", X.HASHES)


@query(f"""WITH {_REPORT} SELECT duplicate_type, hash, count, array_to_string(string_split(members, '|')[1:5], '|') AS members, train_members FROM report""")
def duplicate_display(spark, sf):
    """Buckets with their five smallest members, for display, beside the whole count."""
    n = X.nodes(spark, sf).withColumn("split", F.when(F.col("pool") == "test", "test").otherwise("train"))
    report = duplicates.duplicate_report(n, "node", X.HASHES, max_members=5)
    return report.select("duplicate_type", "hash", "count", F.array_join("members", "|").alias("members"), "train_members")


# -- image statistics by label -----------------------------------------------------------------------------------


@query("""WITH px AS (SELECT label, [least(255, greatest(0, CAST(floor(CAST(x AS DOUBLE) * 40 + 128) AS BIGINT))) for x in embedding] AS g FROM embeddings),
s AS (SELECT label, list_sum(g) / 64.0::DOUBLE AS mean, (g[1] + g[8] + g[57] + g[64]) / 4.0::DOUBLE AS corner_mean, CAST(list_min(g) AS DOUBLE) AS min, CAST(list_max(g) AS DOUBLE) AS max FROM px),
x AS (SELECT label, unnest(['mean', 'corner_mean', 'min', 'max']) AS "column", unnest([mean, corner_mean, min, max]) AS v FROM s),
b AS (SELECT label, "column", count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY ALL)
SELECT "column", b.label, n, min(v) AS low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, max(v) AS high
FROM b JOIN x USING (label, "column") WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) GROUP BY "column", b.label, n""")
def image_numbers_by_label(spark, sf):
    """Box plot numbers of gray statistics by label, of the embeddings read as 8 x 8 images."""
    labels = X.table(spark, sf, "embeddings").select("vec_id", "label")
    stats = QUERIES["image_metadata"](spark, sf).select("vec_id", "mean", "corner_mean", "min", "max").join(labels, "vec_id")
    names = ["mean", "corner_mean", "min", "max"]
    return rounded(metrics.numeric_by_label(stats, names, exact=True), "q1", "median", "q3", digits=6)
