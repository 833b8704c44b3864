"""Aggregates under the names of the engine's dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name in the dialect, and what computes it.
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median,
    "var": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop,
    "covar": F.covar_samp, "covar_samp": F.covar_samp, "covar_pop": F.covar_pop,
}


def aggregate(name: str, *columns: Column | str) -> Column:
    if name.lower() not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name}")
    return AGGREGATES[name.lower()](*columns)
