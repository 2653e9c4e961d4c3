"""Manifests, file indexes, prediction tables, run logs and result files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names under which prediction tables keep their columns, by precedence.
ID_NAMES = ("image_id", "file_name", "id", "sample_id")
PROB_NAMES = ("pred_prob", "prob", "prediction", "probability", "probability_PNEUMONIA", "pneumonia_prob", "label_prob")
LABEL_NAMES = ("true_label", "label", "target")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one for local sessions, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = tempfile.mkdtemp(prefix="spark-tallyframe-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: cuts lineage, and fixes which partition a row came from."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{scratch_dir(spark)}/tallyframe-{tag}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def require_inputs(spark: SparkSession, paths: Sequence[str]) -> None:
    gone = [x for x in paths if not (f := _fs(spark, x))[0].exists(f[1])]
    if gone:
        raise FileNotFoundError("missing inputs: " + ", ".join(gone))


def read_manifest(spark: SparkSession, path: str, schema: str = "file_name string, label int") -> DataFrame:
    require_inputs(spark, [path])
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def file_index(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path, base_name, length of all files below ``root`` but hidden ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace("file://", "") + "/", "")
    return files.select("path", rel.alias("rel_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("base_name"), "length").where(~F.col("base_name").startswith("."))


def resolve_paths(manifest: DataFrame, index: DataFrame, candidates: Sequence[str] = ("{name}", "train/{name}", "test/{name}", "images/{name}"), key: str = "file_name") -> DataFrame:
    """path of every manifest row: the first candidate relative path that exists, else a file of that base name; null if there is none."""
    ranked = F.array(*(
        F.struct(F.lit(i).alias("rank"), F.concat(*(F.col(key) if part is None else F.lit(part) for part in _parts(c))).alias("rel_path")) for i, c in enumerate(candidates)
    ))
    tried = manifest.select(key, F.explode(ranked).alias("c")).select(key, "c.*").join(index.select("rel_path", "path"), "rel_path")
    by_name = manifest.select(key, F.regexp_extract(key, r"([^/]+)$", 1).alias("base_name")).join(index.select("base_name", "path"), "base_name").select(F.col(key), F.lit(len(candidates)).alias("rank"), "path")
    best = tried.select(key, "rank", "path").union(by_name).groupBy(key).agg(F.min(F.struct("rank", "path")).alias("b"))
    return manifest.join(best.select(key, F.col("b.path").alias("path")), key, "left")


def _parts(candidate: str) -> list[str | None]:
    a, _, b = candidate.partition("{name}")
    return [x for x in (a or "", None, b or "") if x is None or x]


def assert_complete(manifest: DataFrame, index: DataFrame, key: str = "file_name", limit: int | None = None) -> None:
    rows = manifest.orderBy(key).limit(limit) if limit else manifest
    gone = rows.join(index.select(F.col("base_name").alias(key)), key, "left_anti").select(key).limit(10).collect()
    if gone:
        raise FileNotFoundError("missing files, the first: " + ", ".join(r[0] for r in gone))


def normalize_predictions(df: DataFrame, model: str, require_label: bool = True) -> DataFrame:
    """sample_id, label, model, prob from whatever of the known names the table uses; raises where one is missing."""
    pick = lambda names: next((n for n in names if n in df.columns), None)
    i, p, y = pick(ID_NAMES), pick(PROB_NAMES), pick(LABEL_NAMES)
    lacking = [kind for kind, c in (("id", i), ("probability", p), ("label", y if require_label else "-")) if c is None]
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)} among {df.columns}")
    label = F.col(y).cast("int") if y else F.lit(None).cast("int")
    return df.select(F.col(i).cast("string").alias("sample_id"), label.alias("label"), F.lit(model).alias("model"), F.col(p).try_cast("double").alias("prob"))


def discover_predictions(spark: SparkSession, root: str, patterns: dict[str, Sequence[str]], require_label: bool = True) -> DataFrame | None:
    """The first file of each model that exists, as one long table; None where a model has none."""
    out = None
    for model, names in patterns.items():
        found = next((x for n in names if (f := _fs(spark, x := f"{root}/{n}"))[0].exists(f[1])), None)
        if found is None:
            return None
        part = normalize_predictions(spark.read.csv(found, header=True), model, require_label)
        out = part if out is None else out.unionByName(part)
    return out


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(glob, header=True).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError("fmt must be csv, json or parquet")
    df.write.mode("overwrite").options(**({"header": True} if fmt == "csv" else {})).format(fmt).save(path)


def write_submissions(sub: DataFrame, path: str, template_path: str | None = None) -> None:
    """One folder a threshold in one job, rows by template order inside; a folder that is or holds the template is refused."""
    if template_path:
        fs, target = _fs(sub.sparkSession, path)
        source = fs.makeQualified(_fs(sub.sparkSession, template_path)[1]).toString()
        target = fs.makeQualified(target).toString().rstrip("/")
        if source == target or source.startswith(target + "/"):
            raise ValueError("the output would overwrite the template")
    sub.repartitionByRange("threshold_milli", "row_idx").sortWithinPartitions("threshold_milli", "row_idx").write.mode("overwrite").partitionBy("threshold_milli").csv(path, header=True)


def write_ordered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet whose rows, by part number and place in the part, are in the order of ``keys``; one sort over all tasks."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)


def read_ordered(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows of ``write_ordered`` with their place from 0, taken from part numbers and row indexes, not from any column."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("int")
    n = rows.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))  # a row a file
    before = Window.partitionBy("_all").orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn(position, F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def copy_bytes(spark: SparkSession, source: str, target: str) -> None:
    """A byte-exact copy of a file or folder. It is streamed to a hidden name beside the target and renamed when whole, so a
    reader meets the old target, none, or the whole new one. A target that is, holds or lies in the source is refused."""
    (fs, a), (out, b) = _fs(spark, source), _fs(spark, target)
    names = [x.makeQualified(p).toString().rstrip("/") + "/" for x, p in ((fs, a), (out, b))]
    if not fs.exists(a):
        raise FileNotFoundError(source)
    if names[0].startswith(names[1]) or names[1].startswith(names[0]):
        raise ValueError("the copy would overwrite its source")
    jvm = spark.sparkContext._jvm
    hidden = jvm.org.apache.hadoop.fs.Path(b.getParent(), f".{b.getName()}-{uuid.uuid4().hex}")
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, out, hidden, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} was not copied")
    if out.exists(b):
        out.delete(b, True)
    if not out.rename(hidden, b):
        raise OSError(f"{target} was not written")
