"""Template-aligned result files, error listings, run logs and the audit checklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tallyframe.functions.columns import binarize, error_type, log_loss
from tallyframe.operators.quantiles import same
from tallyframe.sources.tables import copy_bytes, materialize


# -- predictions and errors ------------------------------------------------------------------------


def enrich_predictions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    pred = binarize(F.col("prob"), threshold)
    return df.withColumns({
        "pred": pred, "prob_negative": 1 - F.col("prob"), "confidence": F.greatest(F.col("prob"), 1 - F.col("prob")),
        "loss": log_loss(F.col("label"), F.col("prob")), "is_correct": F.col("label") == pred,
    })


def errors(df: DataFrame, kind: str | None = None, threshold: float = 0.5, op: str = ">=") -> DataFrame:
    e = df.withColumn("pred", binarize(F.col("prob"), threshold, op)).withColumn("error_type", error_type(F.col("label"), F.col("pred")))
    return e.where(F.col("error_type") == kind) if kind else e.where("error_type <> 'correct'")


def top_cases(df: DataFrame, threshold: float, op: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` most probable rows of each outcome and key. Each task keeps ``k`` of its own before the shuffle."""
    pred = binarize(F.col("prob"), threshold, op)
    case = F.when((F.col("label") == 1) & (pred == 1), "tp").when((F.col("label") == 1) & (pred == 0), "fn").when((F.col("label") == 0) & (pred == 1), "fp")
    place = F.row_number().over(Window.partitionBy(*keys, "case_type").orderBy(F.col("prob").desc(), "sample_id"))
    return df.withColumn("case_type", case).where("case_type IS NOT NULL").withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def check_contract(df: DataFrame, required: Sequence[str], label: str = "label", domain: Sequence[int] = (0, 1)) -> DataFrame:
    """Violations (rule, n): missing columns, labels outside the domain."""
    spark = df.sparkSession
    missing = [(f"missing column {c}", 1) for c in required if c not in df.columns]
    out = spark.createDataFrame(missing, "rule string, n long")
    if label in df.columns:
        bad = df.agg(F.count_if(F.col(label).isNull() | ~F.col(label).isin(*domain)).alias("n")).select(F.lit("label outside the domain").alias("rule"), "n")
        out = out.union(bad.where("n > 0"))
    return out


def flag_repeated(df: DataFrame, col: str) -> DataFrame:
    """``repeated``: whether another row has the same value; nulls are a value like others, every row stays."""
    n = df.groupBy(col).agg((F.count("*") > 1).alias("repeated"))
    return same(df, n, [col])


# -- template and submissions ------------------------------------------------------------------------


def attach_probs(base: DataFrame, df: DataFrame, key: str = "sample_id", how: str = "left") -> DataFrame:
    return base.join(df.select(key, "prob"), key, how)


def attach_metadata(preds: DataFrame, meta: DataFrame, cols: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Columns that clash get the suffix ``_meta``; columns that ``meta`` lacks are left out."""
    named = [F.col(c).alias(f"{c}_meta" if c in preds.columns else c) for c in cols if c in meta.columns]
    return preds.join(meta.select(key, *named), key, "left")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one of the greatest ``order``, as a lookup table keeps the last of repeated keys. A sum, not a sort."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c != key)).select(*df.columns)


def distinct_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the one of the smallest ``order``; ties go by the other columns, so every run keeps the same row."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c != key)).select(*df.columns)


def missing(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.join(actual.select(key), key, "left_anti")


def restrict(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    return df.join(universe.select(key), key, "left_semi")


def align_to_template(template: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """Template rows with their predictions, ``row_idx`` kept; raises on ids that are missing or repeated."""
    n = preds.groupBy(key).agg(F.count("*").alias("_n"))
    bad = template.select(key).join(n, key, "left").agg(F.count_if(F.col("_n").isNull()), F.count_if(F.col("_n") > 1)).first()
    if bad[0] or bad[1]:
        raise ValueError(f"{bad[0]} ids without a prediction, {bad[1]} with several")
    return template.drop("label").join(preds, key)


def submission(template: DataFrame, preds: DataFrame, thresholds: Sequence[int] | None = None, op: str = ">=", key: str = "sample_id") -> DataFrame:
    """row_idx, key, and label at each threshold (thousandths, a row each), or the probability where none is given."""
    base = template.select("row_idx", key).join(preds.select(key, "prob"), key, "left")
    if thresholds is None:
        return base.select("row_idx", key, F.col("prob").alias("label"))
    rows = base.withColumn("threshold_milli", F.explode(F.array(*(F.lit(int(t)) for t in thresholds))))
    return rows.select("threshold_milli", "row_idx", key, binarize(F.col("prob"), F.col("threshold_milli") / 1000.0, op).alias("label"))


def validate_submission(template: DataFrame, sub: DataFrame, key: str = "sample_id", binary: bool = True) -> DataFrame:
    """One row of violation counts: wrong columns (by name and place), missing, extra, repeated, misplaced, null, fractional (where
    labels are binary) and out-of-domain values; ``valid`` if all are 0."""
    a, b = list(template.columns), list(sub.columns)
    wrong = sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))
    t = template.select(F.col("row_idx").alias("_ti"), F.col(key).alias("_tk"))
    s = sub.select(F.col("row_idx").alias("_si"), F.col(key).alias("_sk"), "label")
    j = t.join(s, F.col("_tk") == F.col("_sk"), "full")
    domain = F.col("label").isin(0, 1) if binary else F.col("label").between(0, 1)
    out = j.agg(
        F.count_if(F.col("_sk").isNull()).alias("missing"), F.count_if(F.col("_tk").isNull()).alias("extra"),
        F.count_if(F.col("_ti") != F.col("_si")).alias("misplaced"), F.count_if(F.col("_sk").isNotNull() & F.col("label").isNull()).alias("nulls"),
        F.count_if(F.col("label").isNotNull() & ~domain).alias("out_of_domain"),
        F.count_if(F.lit(binary) & (F.col("label") != F.floor("label"))).alias("fractional"),
        F.lit(wrong).cast("long").alias("wrong_columns"),
    )
    r = sub.groupBy(key).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated"))
    bad = sum((F.col(c) for c in ("missing", "extra", "misplaced", "nulls", "out_of_domain", "repeated", "fractional", "wrong_columns")), F.lit(0))
    return out.crossJoin(F.broadcast(r)).withColumn("valid", bad == 0)


# -- run logs ------------------------------------------------------------------------------------------


#: Epochs that one task folds at most, about.
PART_EPOCHS = 200_000


def _replayed(parts: DataFrame, min_delta, patience: int, start_epoch: int) -> DataFrame:
    """``parts`` (seq, and the state best, best_epoch, waited, stopped that enters it) with the state after the part."""

    def step(acc, x):
        better = acc["best"].isNull() | (x["m"] > acc["best"] + min_delta)
        waited = F.when(better | (x["e"] < start_epoch), F.lit(0)).otherwise(acc["waited"] + 1)
        moved = F.struct(
            F.when(better, x["m"]).otherwise(acc["best"]).alias("best"), F.when(better, x["e"]).otherwise(acc["best_epoch"]).alias("best_epoch"),
            waited.alias("waited"), F.when(waited >= patience, x["e"]).alias("stopped"),
        )
        return F.when(acc["stopped"].isNotNull(), acc).otherwise(moved)

    names = ("best", "best_epoch", "waited", "stopped")
    after = parts.withColumn("_after", F.aggregate("seq", F.struct(*names), step))
    return after.select("_run", "_part", *(F.col(f"_after.{c}").alias(c) for c in names))


def early_stopping(logs: DataFrame, run: str, epoch: str, metric: str, min_delta=0, patience: int = 5, start_epoch: int = 0, part_epochs: int = PART_EPOCHS) -> DataFrame:
    """Replay for each run: best_epoch, best_value, stopped_epoch (null: ran to its end).

    Logs are dealt by ranges of (run, epoch), and a part folds its epochs in order; no run is one list. Where a run goes on
    over several parts, each part is folded from a supposed state (the best value before it), and parts whose entering
    state was not what the part before left are folded again, until all agree; the states pass one boundary a round at
    least and mostly settle in two or three. The driver sees states of such parts only, of which there are two a part at
    most. Rows with a null metric play no part, a run with nothing else has nulls; a null run is a run; repeated epochs
    count one after the other, the smaller metric first.
    """
    own = logs.where(F.col(metric).isNotNull()).select(F.col(run).alias("_run"), F.col(epoch).cast("long").alias("e"), F.col(metric).cast("double").alias("m"))
    spread = max(int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // part_epochs))
    dealt = own.repartitionByRange(spread, "_run", "e", "m").withColumn("_part", F.spark_partition_id())
    parts = materialize(dealt.groupBy("_run", "_part").agg(F.sort_array(F.collect_list(F.struct("e", "m"))).alias("seq"), F.max("m").alias("_top")), "log-parts")
    several = parts.groupBy("_run").agg(F.count("*").alias("_n")).where("_n > 1").select("_run")
    torn = parts.join(F.broadcast(several), parts["_run"].eqNullSafe(several["_run"]), "left_semi")
    whole = parts.join(F.broadcast(several), parts["_run"].eqNullSafe(several["_run"]), "left_anti")
    start = {"best": F.lit(None).cast("double"), "best_epoch": F.lit(None).cast("long"), "waited": F.lit(0), "stopped": F.lit(None).cast("long")}
    done = _replayed(whole.withColumns(start), min_delta, patience, start_epoch).drop("_part")
    order = sorted((tuple(r) for r in torn.select("_run", "_part", "_top").collect()), key=lambda r: r[1])
    if order:
        fields = [parts.schema["_run"], parts.schema["_part"], *_replayed(torn.withColumns(start), min_delta, patience, start_epoch).schema.fields[2:]]
        before, entering, exits = {}, {}, {}
        for r, part, top in order:
            chain = before.setdefault(r, [])
            best = max((t for _, t in chain), default=None)
            entering[r, part] = (best, None, 0, None)
            chain.append((part, top))
        todo = dict(entering)
        while todo:
            states = logs.sparkSession.createDataFrame([(r, p_, *state) for (r, p_), state in todo.items()], StructType([StructField(f.name, f.dataType) for f in fields]))
            states = states.withColumnsRenamed({"_run": "_r", "_part": "_p"})
            met = torn.join(F.broadcast(states), torn["_run"].eqNullSafe(states["_r"]) & (torn["_part"] == states["_p"]))
            exits.update({(x[0], x[1]): tuple(x[2:]) for x in _replayed(met, min_delta, patience, start_epoch).collect()})
            todo = {}
            for r, chain in before.items():
                for (left, _), (right, _) in zip(chain, chain[1:]):
                    if entering[r, right] != exits[r, left]:
                        todo[r, right] = entering[r, right] = exits[r, left]
        rows = [(r, *exits[r, chain[-1][0]]) for r, chain in before.items()]
        done = done.union(logs.sparkSession.createDataFrame(rows, StructType([StructField(f.name, f.dataType) for f in [fields[0], *fields[2:]]])))
    names = logs.select(F.col(run).alias("_name")).distinct()
    return names.join(done, names["_name"].eqNullSafe(done["_run"]), "left").select(
        F.col("_name").alias(run), "best_epoch", F.col("best").alias("best_value"), F.col("stopped").alias("stopped_epoch")
    )


def top_epochs(logs: DataFrame, run: str, order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(run).orderBy(*order)
    return logs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def best_epoch(logs: DataFrame, run: str, order: Sequence[Column]) -> DataFrame:
    return top_epochs(logs, run, order, 1).drop("place")


def leaderboard(runs: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    out = runs.orderBy(*order)
    return out.limit(n) if n is not None else out


def promote(board: DataFrame, source: str, target: str) -> str:
    """Copy the file or folder that the first run of ``board`` names in column ``source`` to ``target``, byte by byte, and give
    its path. ``target`` is replaced by one rename; a board without rows raises."""
    first = board.select(source).first()
    if first is None:
        raise ValueError("no run to promote")
    copy_bytes(board.sparkSession, first[0], target)
    return first[0]


# -- audit ---------------------------------------------------------------------------------------------


def risk_checklist(checks: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(item, status, evidence, action): each check is a one-row frame with ``n`` violations."""
    out = None
    for item, frame, action in checks:
        row = frame.select(
            F.lit(item).alias("item"), F.when(F.col("n") > 0, "WARN").otherwise("PASS").alias("status"), F.col("n").cast("long").alias("evidence"),
            F.when(F.col("n") > 0, action).otherwise("none").alias("action"),
        )
        out = row if out is None else out.union(row)
    return out


def batch_contract(df: DataFrame, value: str, label: str, lo: float, hi: float, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count_if(~F.col(value).between(lo, hi)).alias("out_of_range"), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("bad_labels"),
    )
