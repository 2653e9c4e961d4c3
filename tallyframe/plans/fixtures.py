"""Prediction, duplicate, log and template tables derived from the given tables, each with its SQL for DuckDB.

Probabilities are kept as whole parts per million so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = (0, 1, 2)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SAMPLES_SQL = """samples AS (
  SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS label, o_custkey AS group_id, o_custkey % 5 AS fold FROM orders)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") != "O", 1).otherwise(0).alias("label"),
        F.col("o_custkey").alias("group_id"), (F.col("o_custkey") % 5).alias("fold"),
    )


PREDICTIONS_SQL = """p AS (
  SELECT sample_id, label, fold, model, view,
         CAST(greatest(0, least(999999, base + ((sample_id * 7 + view * 13) % 41 - 20) * 500)) AS BIGINT) AS ppm
  FROM (SELECT o_orderkey AS sample_id, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS label, o_custkey % 5 AS fold, model,
               CASE WHEN o_orderstatus <> 'O' THEN 450000 ELSE 0 END
                 + CAST(floor(((o_orderkey * (7919 + model * 209458) + model * 31) % 10007) * 550000 / 10007.0) AS BIGINT) AS base
        FROM orders CROSS JOIN (SELECT 0 AS model UNION ALL SELECT 1 UNION ALL SELECT 2)) s
  CROSS JOIN (SELECT 0 AS view UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, label, fold, model, view, ppm, prob: a projection of the orders, exploded in place."""
    o = table(spark, sf, "orders").withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).withColumn("view", F.explode(F.array(*map(F.lit, range(4)))))
    label = F.when(F.col("o_orderstatus") != "O", 1).otherwise(0)
    base = label * 450000 + F.floor(((F.col("o_orderkey") * (7919 + F.col("model") * 209458) + F.col("model") * 31) % 10007) * 550000 / 10007.0)
    jitter = ((F.col("o_orderkey") * 7 + F.col("view") * 13) % 41 - 20) * 500
    return o.select(
        F.col("o_orderkey").alias("sample_id"), label.alias("label"), (F.col("o_custkey") % 5).alias("fold"), "model", "view",
        F.greatest(F.lit(0), F.least(F.lit(999999), base + jitter)).cast("long").alias("ppm"),
    ).withColumn("prob", F.col("ppm") / 1000000.0)


#: Sums of the four views, and a row a sample with the three models' sums.
VIEWS_SQL = PREDICTIONS_SQL + """,
v AS (SELECT sample_id, label, model, fold, CAST(sum(ppm) AS BIGINT) AS s4 FROM p GROUP BY sample_id, label, model, fold),
w AS (SELECT sample_id, label, max(CASE WHEN model = 0 THEN s4 END) AS m_0, max(CASE WHEN model = 1 THEN s4 END) AS m_1,
             max(CASE WHEN model = 2 THEN s4 END) AS m_2 FROM v GROUP BY sample_id, label)"""


def views(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf)
    return p.groupBy("sample_id", "label", "model", "fold").agg(F.sum("ppm").alias("s4")).withColumn("prob", F.col("s4") / 4000000.0)


#: A text's grid has 8 rows and 9 columns; every word is counted in the cell that its first character and its length name.
CELLS = 72

_HEX = "substr('0123456789abcdef', CAST(list_sum([({bit}) * (8 // CAST(pow(2, j) AS BIGINT)) for j in range(4)]) + 1 AS BIGINT), 1)"
_AHASH = _HEX.format(bit="CASE WHEN 64 * g[4*k+j+1] > total THEN 1 ELSE 0 END")
_DHASH = _HEX.format(bit="CASE WHEN g[((4*k+j)//8)*9 + (4*k+j)%8 + 2] > g[((4*k+j)//8)*9 + (4*k+j)%8 + 1] THEN 1 ELSE 0 END")

#: Documents as one node table with three hashes: of the content, and both perceptual hashes, all 64 bits, of its grid of words
#: (the average hash takes the first 64 cells). Labelled nodes are the training pool.
NODES_SQL = f"""words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
cells AS (SELECT doc_id, CAST((unicode(w) * 31 + length(w)) % {CELLS} AS INTEGER) AS cell, count(*) AS n FROM words WHERE w <> '' GROUP BY 1, 2),
maps AS (SELECT doc_id, map(list(cell), list(n)) AS m FROM cells GROUP BY doc_id),
grids AS (SELECT doc_id, g, list_sum(g[1:64]) AS total FROM (SELECT doc_id, [coalesce(m[k], 0) for k in range({CELLS})] AS g FROM maps)),
nodes AS (
  SELECT d.doc_id AS node, l.quality AS label, CASE WHEN l.doc_id IS NULL THEN 'test' ELSE 'train' END AS pool, sha256(d.text) AS exact_sha256,
         CASE WHEN g IS NULL THEN NULL ELSE list_aggregate([{_AHASH} for k in range(16)], 'string_agg', '') END AS ahash64,
         CASE WHEN g IS NULL THEN NULL ELSE list_aggregate([{_DHASH} for k in range(16)], 'string_agg', '') END AS dhash64
  FROM documents d LEFT JOIN grids ON grids.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """node, label, pool, exact_sha256, ahash64, dhash64; written once, so that whatever reads it twice hashes once."""
    from tallyframe.operators.duplicates import ahash, dhash, once
    from tallyframe.sources.tables import materialize

    y = table(spark, sf, "labels").select(F.col("doc_id").alias("node"), F.col("quality").alias("label")).distinct()
    d = table(spark, sf, "documents")
    words = d.select("doc_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    # a document's words stand in one task, so what is shuffled are its cells
    cells = words.groupBy("doc_id", ((F.ascii("w") * 31 + F.length("w")) % CELLS).alias("cell")).agg(F.count("*").alias("n"))
    counts = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    both = once(grid, lambda g: F.struct(ahash(F.slice(g, 1, 64)).alias("a"), dhash(g).alias("d")))
    hashes = counts.select(F.col("doc_id").alias("node"), both.alias("h"))
    d = d.select(F.col("doc_id").alias("node"), F.sha2("text", 256).alias("exact_sha256")).join(hashes, "node", "left")
    return materialize(d.join(y, "node", "left").select(
        "node", "label", F.when(F.col("label").isNull(), "test").otherwise("train").alias("pool"), "exact_sha256", F.col("h.a").alias("ahash64"), F.col("h.d").alias("dhash64")
    ), "nodes")


HASHES = ("exact_sha256", "ahash64", "dhash64")

RUNS_SQL = """logs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """run, epoch (from 1), cents: each user's events as a training log."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("epoch"), F.round(F.col("value") * 100).cast("long").alias("cents")
    )
