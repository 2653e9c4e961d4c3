"""Images as rows: decoding, intensity statistics, small gray grids for perceptual hashes, and mean images by label.

The only vectorised Python of this library besides the text part: ``image.data`` goes to NumPy batch by batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.columns import file_suffix
from tallyframe.operators.quantiles import same
from tallyframe.sources.tables import file_index

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STATS = "width int, height int, channels int, aspect_ratio double, mean double, std double, min double, max double, border_mean double, corner_mean double, readable boolean"


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path and the image struct; a file that cannot be decoded stays, with width -1."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    return images.select(F.col("image.origin").alias("path"), "image")


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """path, file_size, suffix (lower case, with its dot) of all files below ``root``; contents are not read."""
    return file_index(spark, root).select("path", F.col("length").alias("file_size"), file_suffix(F.col("base_name")).alias("suffix"))


def gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Rows by columns of luma; colour data is blue, green, red (, alpha)."""
    px = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return px[..., 0] if channels == 1 else px[..., 2] * 0.299 + px[..., 1] * 0.587 + px[..., 0] * 0.114


def _describe(px: np.ndarray, border: float, corner: float) -> tuple:
    h, w = px.shape
    b, c = max(1, round(border * min(h, w))), max(1, round(corner * min(h, w)))
    frame = np.ones_like(px, dtype=bool)
    frame[b : h - b, b : w - b] = False
    corners = np.concatenate([px[:c, :c].ravel(), px[:c, -c:].ravel(), px[-c:, :c].ravel(), px[-c:, -c:].ravel()])
    return px.mean(), px.std(), px.min(), px.max(), px[frame].mean(), corners.mean()


def image_metadata(images: DataFrame, keys: Sequence[str] = ("path",), border: float = 0.05, corner: float = 0.12) -> DataFrame:
    """Size and gray statistics (population deviation) of each image; null, and readable false, where it is not decodable."""
    schema = images.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, h, n, data in zip(pdf.pop("_w"), pdf.pop("_h"), pdf.pop("_n"), pdf.pop("_d"), strict=True):
                if w is None or w <= 0 or not data:
                    rows.append((None, None, None, None, *[None] * 6, False))
                else:
                    rows.append((w, h, n, w / h, *_describe(gray(data, w, h, n), border, corner), True))
            stats = pd.DataFrame(rows, columns=[c.split()[0] for c in _STATS.split(", ")], index=pdf.index)
            yield pd.concat([pdf, stats.astype({"width": "Int32", "height": "Int32", "channels": "Int32"})], axis=1)

    flat = images.select(*keys, F.col("image.width").alias("_w"), F.col("image.height").alias("_h"), F.col("image.nChannels").alias("_n"), F.col("image.data").alias("_d"))
    return flat.mapInPandas(run, f"{schema}, {_STATS}")


def describe_files(spark: SparkSession, root: str, border: float = 0.05, corner: float = 0.12) -> DataFrame:
    """Size and suffix of every file below ``root`` with its gray statistics; a file that is no image stays, with readable false."""
    stats = image_metadata(read_images(spark, root), border=border, corner=corner)
    same_path = lambda df: df.withColumn("_at", F.regexp_replace("path", "^[a-z0-9]+:/*", "/"))
    both = same_path(file_facts(spark, root)).join(same_path(stats).drop("path"), "_at", "left").drop("_at")
    return both.withColumn("readable", F.coalesce("readable", F.lit(False)))


def _kernel(size: int, out: int) -> np.ndarray:
    """Lanczos-3 weights (out, size), widened when shrinking, as separable resizing has them."""
    scale = size / out
    support = 3 * max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    x = (np.arange(size) + 0.5 - centre[:, None]) / max(scale, 1.0)
    k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0) * (np.abs(np.arange(size) + 0.5 - centre[:, None]) < support)
    return k / k.sum(axis=1, keepdims=True)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(np.rint(_kernel(px.shape[0], height) @ px @ _kernel(px.shape[1], width).T), 0, 255)


def to_grid(images: DataFrame, width: int, height: int, name: str = "grid") -> DataFrame:
    """Adds a gray grid of ``height`` rows by ``width``, row by row, for the hashes; null where the image is not decodable.

    Own Lanczos-3 resizing: of the same family as common image libraries, not equal to any of them to the bit.
    """

    @F.pandas_udf("array<double>")
    def shrink(w: pd.Series, h: pd.Series, n: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([resize(gray(d, a, b, c), width, height).ravel().tolist() if d and a > 0 else None for a, b, c, d in zip(w, h, n, data, strict=True)])

    return images.withColumn(name, shrink("image.width", "image.height", "image.nChannels", "image.data"))


def grid_mean(grid: Column, width: int, height: int, part: str) -> Column:
    """Mean of the outermost frame (``border``) or of the four corner cells (``corner``) of a grid, in plain expressions."""
    rows, cols = (0, height - 1), (0, width - 1)
    pick = [r * width + c for r in range(height) for c in range(width) if (r in rows and c in cols if part == "corner" else r in rows or c in cols)]
    return sum((F.get(grid, F.lit(i)).cast("double") for i in pick[1:]), F.get(grid, F.lit(pick[0])).cast("double")) / len(pick)


def mean_grid_by_label(
    df: DataFrame, grid: str, width: int, label: str = "label", border: int | None = None, height: int | None = None, max_per_label: int | None = None, key: str = "path"
) -> DataFrame:
    """Mean of every cell by label; with ``border`` only cells of a frame so wide, with ``max_per_label`` over so many rows of each
    label, chosen by a hash of ``key``."""
    if max_per_label is not None:
        place = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit("42:"), F.col(key).cast("string"))), key))
        df = df.withColumn("_place", place).where(F.col("_place") <= max_per_label)
    cells = df.select(F.col(label).alias("label"), F.posexplode(grid).alias("pos", "value")).where("value IS NOT NULL")
    row, col = F.floor(F.col("pos") / width), (F.col("pos") % width).cast("long")
    out = cells.groupBy("label", row.alias("row"), col.alias("col")).agg(F.avg(F.col("value").cast("double")).alias("mean"), F.count("*").alias("n"))
    if border is None:
        return out
    h = height or width
    return out.where((F.col("row") < border) | (F.col("row") >= h - border) | (F.col("col") < border) | (F.col("col") >= width - border))


def mapping_check(manifest: DataFrame, resolved: DataFrame, metadata: DataFrame, key: str = "file_name") -> DataFrame:
    """exists, readable, duplicated of every manifest row; ``resolved`` has key and path, ``metadata`` path and readable.

    Rows without a name stay, and count as copies of each other.
    """
    n = manifest.groupBy(key).agg((F.count("*") > 1).alias("duplicated"))
    known = resolved.select(key, "path").distinct().join(metadata.select("path", "readable"), "path", "left")
    return same(same(manifest, n, [key]), known, [key], "left").withColumns({"exists": F.col("path").isNotNull(), "readable": F.coalesce("readable", F.lit(False))})
