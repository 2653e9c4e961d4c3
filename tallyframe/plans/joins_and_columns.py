"""More registered queries: column rules, joins by key, unions and group numbers, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import columns as C
from tallyframe.operators import duplicates, ensemble, metrics, results, splits
from tallyframe.plans import fixtures as X
from tallyframe.plans.registry import (
    _GROUPS, _HASH, _NAMED, _SIDES, _best, _blended, _BLEND, _counts, _grid, _named, _sample_rows, _template, group_holdout, query, rounded,
    threshold_sweep,
)
from tallyframe.sources import images, tables

# -- column rules ------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS class_name, CASE quality WHEN 0 THEN '0 (poor)' WHEN 1 THEN '1 (good)' ELSE coalesce(CAST(quality AS VARCHAR), 'missing') END AS shown,
coalesce(CAST(toxic AS VARCHAR), 'missing') AS plain FROM labels""")
def label_columns(spark, sf):
    """Class names and display texts of the labels."""
    names = {0: "poor", 1: "good"}
    return X.table(spark, sf, "labels").select(
        "doc_id", C.class_name(F.col("quality"), names).alias("class_name"), C.label_display(F.col("quality"), names).alias("shown"), C.label_display(F.col("toxic")).alias("plain")
    )


@query("""SELECT o_orderkey, trim(m) AS member FROM (SELECT o_orderkey, unnest(string_split(' ' || o_custkey || ' | ' || o_orderstatus || '|| ' || o_orderkey || '|', '|')) AS m FROM orders) WHERE trim(m) <> ''""")
def member_lists(spark, sf):
    """Lists written with bars, as rows."""
    text = F.concat(F.lit(" "), "o_custkey", F.lit(" | "), "o_orderstatus", F.lit("|| "), "o_orderkey", F.lit("|"))
    return X.table(spark, sf, "orders").select("o_orderkey", F.explode(C.split_members(text)).alias("member"))


@query(f"""WITH {X.VIEWS_SQL}, z AS (SELECT sample_id, (m_0 - 2000000) / 500000.0::DOUBLE AS a, (m_1 - 2000000) / 500000.0::DOUBLE AS b, (m_0 + m_1 + m_2) / 3.0::DOUBLE AS m FROM w)
SELECT sample_id, round(1 / (1 + exp(-b)), 9) AS one_logit, round(exp(b) / (exp(a) + exp(b)), 9) AS two_logits, CASE WHEN b > a THEN 1 ELSE 0 END AS pred, round(m, 6) AS mean FROM z""")
def logit_columns(spark, sf):
    """One logit by the sigmoid, two by the softmax, the decision, and the mean over models."""
    w = ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4")
    a, b = ((F.col(c) - 2000000) / 500000.0 for c in ("m_0", "m_1"))
    out = w.select(
        "sample_id", C.sigmoid(b).alias("one_logit"), F.get(C.softmax(F.array(a, b)), F.lit(1)).alias("two_logits"), C.argmax(F.array(a, b)).alias("pred"),
        C.row_mean(["m_0", "m_1", "m_2"]).alias("mean"),
    )
    return rounded(rounded(out, "one_logit", "two_logits"), "mean", digits=6)


@query(f"""SELECT * FROM (SELECT model, unnest(list_sort(list_distinct([least(greatest(threshold_milli + o, 50), 950) for o in [-400, -50, -10, 0, 10, 50, 400]]))) AS threshold_milli FROM ({_best("accuracy")}))""")
def threshold_brackets(spark, sf):
    """Thresholds around each model's best one."""
    best = metrics.best_threshold(threshold_sweep(spark, sf), "accuracy", ["model"])
    at = C.threshold_bracket(F.col("threshold_milli"), (-400, -50, -10, 0, 10, 50, 400))
    return best.select("model", F.explode(at).alias("threshold_milli"))


@query("""SELECT o_orderkey, try_cast(t AS DOUBLE) AS value, format('{:.2f}%', (o_orderkey % 100) / 100.0::DOUBLE * 100) AS share
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS t FROM orders)""")
def text_to_numbers(spark, sf):
    """Numbers written as text; what is none becomes null."""
    key = F.col("o_orderkey") % 3
    text = F.when(key == 0, "n/a").when(key == 1, F.col("o_custkey").cast("string")).otherwise(F.concat("o_custkey", F.lit(".5")))
    return X.table(spark, sf, "orders").select("o_orderkey", C.to_double(text).alias("value"), C.percent(F.col("o_orderkey") % 100 / 100.0).alias("share"))


@query("""SELECT 'missing column source_file' AS rule, 1::BIGINT AS n UNION ALL SELECT 'label outside the domain', count(*) FROM labels WHERE doc_id % 7 = 0 OR quality IS NULL HAVING count(*) > 0""")
def contract_violations(spark, sf):
    """Violations of a table contract with planted faults: a column is not there, some labels are foreign."""
    y = X.table(spark, sf, "labels").withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 5).otherwise(F.col("quality")))
    return results.check_contract(y, ["doc_id", "quality", "source_file"], "quality")


@query("""SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS repeated FROM documents WHERE text IS NOT NULL""")
def repeated_rows(spark, sf):
    """Documents whose text another one has."""
    d = duplicates.content_hash(X.table(spark, sf, "documents").where("text IS NOT NULL"), "text")
    return results.flag_repeated(d.select("doc_id", "exact_sha256"), "exact_sha256").select("doc_id", "repeated")


@query(f"WITH {X.PREDICTIONS_SQL} SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(label AS INTEGER) AS label, 'm' AS model, ppm / 1000000.0::DOUBLE AS prob FROM p")
def normalized_predictions(spark, sf):
    """A prediction table under foreign column names, brought to the common ones."""
    p = X.predictions(spark, sf).select(F.col("sample_id").alias("image_id"), F.col("label").alias("target"), F.col("prob").cast("string").alias("pneumonia_prob"))
    return tables.normalize_predictions(p, "m")


@query(f"""WITH {X.PREDICTIONS_SQL} SELECT model, count(*) AS n, min(ppm / 1000000.0::DOUBLE) AS min_value, max(ppm / 1000000.0::DOUBLE) AS max_value, count(*) FILTER (WHERE ppm > 900000) AS out_of_range, count(*) FILTER (WHERE sample_id % 11 = 0) AS bad_labels FROM p GROUP BY model""")
def batch_contract(spark, sf):
    """Range and label domain of every model's table, with planted faults."""
    p = X.predictions(spark, sf).withColumn("label", F.when(F.col("sample_id") % 11 == 0, None).otherwise(F.col("label")))
    return results.batch_contract(p, "prob", "label", 0.0, 0.9, ["model"])


# -- joins by key --------------------------------------------------------------------------------------


@query(f"WITH {X.VIEWS_SQL} SELECT sample_id, max(s4) FILTER (WHERE model = 0) AS m_0, max(s4) FILTER (WHERE model = 1 AND sample_id % 5 <> 0) AS m_1, max(s4) FILTER (WHERE model = 2) AS m_2 FROM v GROUP BY sample_id")
def pivot_without_label(spark, sf):
    """A row a sample without labels; where a model has none its column is null."""
    v = X.views(spark, sf).where("NOT (model = 1 AND sample_id % 5 = 0)")
    return ensemble.pivot_models(v, X.MODELS, label=None, value="s4", require_complete=False)


@query(f"WITH {X.VIEWS_SQL}, {X.SAMPLES_SQL} SELECT s.sample_id, s.label, CASE WHEN s.sample_id % 3 <> 0 THEN round(v.s4 / 4000000.0::DOUBLE, 9) END AS prob FROM samples s JOIN v ON v.sample_id = s.sample_id AND v.model = 1")
def attached_probs(spark, sf):
    """Probabilities beside the samples; null where there is none."""
    v = X.views(spark, sf).where("model = 1 AND sample_id % 3 <> 0")
    return rounded(results.attach_probs(X.samples(spark, sf).select("sample_id", "label"), v), "prob")


@query(f"WITH {X.VIEWS_SQL} SELECT sample_id, model, label, o_orderstatus AS label_meta, o_custkey FROM v JOIN orders ON o_orderkey = sample_id")
def attached_metadata(spark, sf):
    """Metadata beside the predictions: a clashing name gets a suffix, a column that is not there is left out."""
    meta = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("label"), "o_custkey")
    return results.attach_metadata(X.views(spark, sf).select("sample_id", "model", "label"), meta, ["label", "o_custkey", "device"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0)")
def restricted_rows(spark, sf):
    """Orders of a universe of customers, by a semi-join."""
    universe = X.table(spark, sf, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return results.restrict(X.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), universe, "o_custkey")


@query(f"WITH {_BLEND} SELECT row_number() OVER (ORDER BY sample_id) - 1 AS row_idx, sample_id, s12 FROM b")
def template_alignment(spark, sf):
    """Predictions in the template's order; missing and repeated ids raise."""
    return results.align_to_template(_template(spark, sf), _blended(spark, sf).select("sample_id", "s12"), "sample_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_by_key(spark, sf):
    """The last row of every user, as a lookup table keeps the last of repeated keys."""
    return results.last_by_key(X.table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT exact_sha256, doc_id, source FROM (SELECT sha256(text) AS exact_sha256, doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def distinct_by_key(spark, sf):
    """One document of every text, always the one of the smallest id."""
    d = duplicates.content_hash(X.table(spark, sf, "documents").where("text IS NOT NULL"), "text")
    return results.distinct_by(d.select("exact_sha256", "doc_id", "source"), "exact_sha256", "doc_id")


@query(f"""WITH {_NAMED}, f AS (SELECT file_name, bool_and(sample_id % 7 <> 0) AS ok FROM named WHERE sample_id % 4 <> 0 GROUP BY 1), n AS (SELECT file_name, count(*) > 1 AS duplicated FROM named GROUP BY 1)
SELECT named.file_name, 'file:/data/' || f.file_name AS path, coalesce(ok, false) AS readable, f.file_name IS NOT NULL AS exists, duplicated FROM named JOIN n USING (file_name) LEFT JOIN f ON f.file_name = named.file_name""")
def mapping_check(spark, sf):
    """Every manifest row with whether its file is there and readable."""
    m = _named(spark, sf)
    found = m.where("sample_id % 4 <> 0").select("file_name", F.concat(F.lit("file:/data/"), "file_name").alias("path"), (F.col("sample_id") % 7 != 0).alias("ok"))
    found = found.groupBy("file_name", "path").agg(F.bool_and("ok").alias("readable"))
    return images.mapping_check(m.select("file_name"), found, found, "file_name")


# -- unions, samples and folds ---------------------------------------------------------------------------


@query(f"WITH {_SIDES} SELECT split AS source, sample_id, label FROM gh")
def tagged_union(spark, sf):
    """Both sides of a split as one table that says where a row came from."""
    h = group_holdout(spark, sf)
    side = lambda name: h.where(F.col("split") == name).select(F.lit(name).alias("source"), "sample_id", "label")
    return side("train").unionByName(side("val"))


@query(f"""WITH {_BLEND}, {X.SAMPLES_SQL} SELECT sample_id, label, 1.0::DOUBLE AS sample_weight, fold FROM samples WHERE fold <> 2
UNION ALL SELECT sample_id, CASE WHEN s12 >= 10800000 THEN 1 ELSE 0 END, CAST(0.35 AS DOUBLE), NULL FROM b WHERE s12 <= 1200000 OR s12 >= 10800000""")
def pseudo_union(spark, sf):
    """Training rows of a fold with the pseudo-labelled rows, weighted."""
    pseudo = ensemble.pseudo_labels(_blended(spark, sf), 0.1, 0.9).select("sample_id", "label")
    return ensemble.with_pseudo(X.samples(spark, sf).select("sample_id", "label", "fold"), pseudo, fold=2)


@query(f"WITH {X.SAMPLES_SQL}, i AS (SELECT unnest(range(5)) AS held) SELECT held, CASE WHEN fold = held THEN 'val' ELSE 'train' END AS side, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives FROM samples, i GROUP BY 1, 2")
def fold_frames(spark, sf):
    """Rows and positives of both sides, each fold held out in turn."""
    turns = splits.held_out_in_turn(X.samples(spark, sf), 5)
    return turns.groupBy("held", "side").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


@query(f"""WITH {_NAMED}, e AS (SELECT named.sample_id, file_name, CASE named.sample_id % 3 WHEN 0 THEN 'case_' || group_id WHEN 1 THEN 'patient-' || group_id ELSE file_name END AS g FROM named JOIN samples USING (sample_id)),
r AS (SELECT g, row_number() OVER (ORDER BY {_HASH.format("g")}) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM e))
SELECT sample_id, file_name, CASE WHEN r < greatest(round(CAST(0.2 AS DOUBLE) * n), 1) THEN 'val' ELSE 'train' END AS split FROM e JOIN r USING (g)""")
def auto_holdout(spark, sf):
    """A split by entities read from the file names, as no column names a group."""
    return splits.auto_holdout(_named(spark, sf).select("sample_id", "file_name"), 0.2)[0].select("sample_id", "file_name", "split")


@query(f"""WITH {X.SAMPLES_SQL} SELECT sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format("sample_id")}) AS k FROM samples) WHERE k <= 8""")
def samples_per_label(spark, sf):
    """A sample of eight rows of each label."""
    return splits.stratified_sample(_sample_rows(spark, sf), 0, per_label=8).select("sample_id", "label")


@query(f"""WITH {X.PREDICTIONS_SQL}, c AS (SELECT model, {_counts('ppm', '400000')} FROM p GROUP BY model),
s AS (SELECT model, 'negative' AS class, tn / CAST(tn + fn AS DOUBLE) AS precision, tn / CAST(tn + fp AS DOUBLE) AS recall, 2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f1, tn + fp AS support FROM c
      UNION ALL SELECT model, 'positive', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE), 2 * tp / CAST(2 * tp + fn + fp AS DOUBLE), tp + fn FROM c)
SELECT model, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM s
UNION ALL SELECT model, 'macro avg', round(sum(precision) / 2, 9), round(sum(recall) / 2, 9), round(sum(f1) / 2, 9), CAST(sum(support) AS BIGINT) FROM s GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM s GROUP BY model""")
def class_report_by_model(spark, sf):
    return rounded(metrics.class_report(X.predictions(spark, sf), 0.4, keys=["model"]), "precision", "recall", "f1")


@query(f"""WITH {X.PREDICTIONS_SQL}, c AS (SELECT model, fold, {_counts('ppm', '500000')} FROM p GROUP BY model, fold)
SELECT model, round(avg((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE)), 9) AS accuracy, round(avg(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)), 9) AS f1 FROM c GROUP BY model""")
def mean_metrics_by_model(spark, sf):
    """Means over the folds of each model's metrics."""
    return rounded(metrics.mean_by(ensemble.fold_metrics(X.predictions(spark, sf)), ["model"], ["accuracy", "f1"]), "accuracy", "f1")


@query(f"""WITH {X.VIEWS_SQL}, {_grid(200, 800, 5)}, best AS (SELECT weight_id, cut FROM c WHERE slot >= 0 ORDER BY CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) DESC, weight_id, cut LIMIT 1)
SELECT sample_id, label, m_0 * w_0 + m_1 * w_1 + m_2 * w_2 AS parts, CASE WHEN m_0 * w_0 + m_1 * w_1 + m_2 * w_2 >= cut * 80000 THEN 1 ELSE 0 END AS pred FROM w, best JOIN g USING (weight_id)""")
def best_weights_applied(spark, sf):
    """The best weights and threshold by F1, applied to every sample."""
    wide, grid = ensemble.pivot_models(X.views(spark, sf), X.MODELS, value="s4"), ensemble.simplex_grid(spark, X.MODELS)
    best = ensemble.grid_search(wide, grid, X.MODELS, 20, 200, 800, 5, "f1", scale=4000000).join(grid, "weight_id")
    out = ensemble.apply_best(wide, best.select("threshold_milli", "w_0", "w_1", "w_2"), X.MODELS, 20, scale=4000000)
    return out.select("sample_id", "label", F.round(F.col("prob") * 80000000).cast("long").alias("parts"), "pred")


# -- duplicate evidence and groups ------------------------------------------------------------------------


def _train_groups_sql() -> str:
    """The groups over training rows alone: the node table of the common SQL, restricted."""
    return _GROUPS.replace(X.NODES_SQL, X.NODES_SQL.replace("nodes AS (", "every_node AS (", 1) + ", nodes AS (SELECT * FROM every_node WHERE pool = 'train')", 1)


def _train_groups(spark, sf):
    n = X.nodes(spark, sf).where("pool = 'train'")
    return duplicates.components(n, duplicates.evidence_edges(n, "node", X.HASHES), "node")


@query(f"WITH {_train_groups_sql()} SELECT duplicate_type, hash, count(*) AS train_file_count FROM long GROUP BY 1, 2 HAVING count(*) > 1")
def train_evidence(spark, sf):
    """Hashes that two or more training rows share."""
    return duplicates.train_evidence(X.nodes(spark, sf), "node", X.HASHES)


@query(f"WITH {_train_groups_sql()}, roots AS (SELECT group_id, 'dup_group_' || format('{{:05d}}', row_number() OVER (ORDER BY group_id)) AS duplicate_group_id FROM (SELECT DISTINCT group_id FROM comp)) SELECT node, duplicate_group_id FROM comp JOIN roots USING (group_id)")
def numbered_groups(spark, sf):
    """Groups by evidence among training rows alone, numbered by their smallest member."""
    groups = _train_groups(spark, sf)
    return duplicates.assign_groups(groups.select("node"), groups, "node")


# -- mean images -----------------------------------------------------------------------------------------


@query("""WITH px AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings)
SELECT label, pos // 8 AS row, pos % 8 AS col, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM px WHERE pos // 8 IN (0, 1, 6, 7) OR pos % 8 IN (0, 1, 6, 7) GROUP BY 1, 2, 3""")
def border_grid_by_label(spark, sf):
    """Mean images of a frame two cells wide."""
    return rounded(images.mean_grid_by_label(X.table(spark, sf, "embeddings"), "embedding", 8, "label", border=2), "mean", digits=6)


@query(f"""WITH s AS (SELECT label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format("vec_id")}, vec_id) AS k FROM embeddings) WHERE k <= 500),
px AS (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM s) SELECT label, pos // 8 AS row, pos % 8 AS col, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS n FROM px GROUP BY 1, 2, 3""")
def sampled_grid_by_label(spark, sf):
    """Mean images over a sample of 500 rows of each label."""
    e = X.table(spark, sf, "embeddings")
    return rounded(images.mean_grid_by_label(e, "embedding", 8, "label", max_per_label=500, key="vec_id"), "mean", digits=6)
