"""Column expressions: labels, names, probabilities. Each takes and gives a ``Column``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an entity may stand in a file name; the first that matches counts, and the whole match is its name.
ENTITY_PATTERNS = (
    r"(?i)(patient[_-]?\d+)",
    r"(?i)(subject[_-]?\d+)",
    r"(?i)(study[_-]?\d+)",
    r"(?i)(case[_-]?\d+)",
    r"(?i)(person[_-]?\d+)",
)


def class_name(label: Column, mapping: dict[int, str]) -> Column:
    """Name of a label; null where the mapping has none."""
    names = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(names, label.cast("int"))


def label_display(label: Column, mapping: dict[int, str] | None = None) -> Column:
    """``1 (positive)`` for known labels, the plain text for all others, ``missing`` for null."""
    number = F.expr("NULL") if mapping is None else class_name(label.try_cast("int"), mapping)
    shown = F.concat(label.cast("string"), F.lit(" ("), number, F.lit(")")) if mapping else F.lit(None).cast("string")
    return F.coalesce(shown, label.cast("string"), F.lit("missing"))


def entity_from_name(name: Column, patterns: Sequence[str] = ENTITY_PATTERNS) -> Column:
    """Lower-cased entity (kind and number) from the stem of a file name, null where no pattern matches."""
    stem = file_stem(name)
    return F.lower(F.coalesce(*(F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in patterns)))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    """Lower-cased suffix with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def split_members(col: Column, sep: str = "|") -> Column:
    """Array of the trimmed, non-empty parts."""
    parts = F.transform(F.split(col, "[" + sep + "]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def binarize(prob: Column, threshold: float | Column, op: str = ">=") -> Column:
    if op not in (">", ">="):
        raise ValueError("op must be '>' or '>='")
    return ((prob >= threshold) if op == ">=" else (prob > threshold)).cast("int")


def error_type(label: Column, pred: Column, positive: int = 1) -> Column:
    return (
        F.when(label == pred, "correct").when(label == positive, "fn").when(label.isNotNull() & pred.isNotNull(), "fp")
    )


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    raised = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Index from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def to_double(col: Column) -> Column:
    return col.try_cast("double")


def percent(col: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(col * 100, digits), F.lit("%"))


def log_loss(label: Column, prob: Column, eps: float = 1e-7) -> Column:
    p = F.greatest(F.least(prob, F.lit(1 - eps)), F.lit(eps))
    return F.when(label == 1, -F.log(p)).otherwise(-F.log(1 - p))


def threshold_bracket(best_milli: Column, offsets_milli: Sequence[int], lo: int = 50, hi: int = 950) -> Column:
    """Sorted distinct thresholds around the best, in thousandths, clipped to [lo, hi]."""
    moved = F.transform(F.array(*map(F.lit, offsets_milli)), lambda o: F.least(F.greatest(best_milli + o, F.lit(lo)), F.lit(hi)))
    return F.sort_array(F.array_distinct(moved))


def row_mean(columns: Sequence[str]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
