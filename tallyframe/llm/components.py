"""Connected components of links, by the library's star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyframe.operators.duplicates import star_components


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b); the component is its smallest vertex. No edges, no rows."""
    return star_components(edges)
