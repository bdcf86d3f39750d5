"""Right-closed interval labels: edges and text on the driver, lookup in Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges of ``bins`` equal intervals; the first is lowered so ``low`` is inside."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    _, edges = pd.cut(np.array([low, high], dtype=float), bins, retbins=True)
    return [float(e) for e in edges]


def interval_labels(edges: list[float], include_lowest: bool = False) -> list[str]:
    """Text of each (lo, hi] interval; repeated edges are an error."""
    cut = pd.cut(np.array(edges[1:], dtype=float), np.array(edges, dtype=float), include_lowest=include_lowest)
    return [str(interval) for interval in cut.categories]


def interval_lookup(value: Column, edges: list[float], results: list) -> Column:
    """``results[i]`` where edges[i] < value <= edges[i+1], else NULL.

    Built as a balanced tree of comparisons with the inner edges, so a row costs
    log2(bins) comparisons inside generated code.
    """

    def branch(first: int, last: int) -> Column:
        if first == last:
            return F.lit(results[first])
        middle = (first + last) // 2
        return F.when(value <= F.lit(float(edges[middle + 1])), branch(first, middle)).otherwise(
            branch(middle + 1, last)
        )

    inside = (value > F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1])))
    return F.when(inside, branch(0, len(results) - 1))
