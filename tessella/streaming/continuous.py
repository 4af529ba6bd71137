"""The dialect's filters, projections and groups over Structured Streaming sources.

The dialect has no windows or watermarks; they come as arguments here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import GeneralError, NotImplementedFeature
from tessella.plans import ast as A
from tessella.plans.binder import Selection
from tessella.plans.parser import parse
from tessella.plans.query import source


def select(stream: DataFrame, name: str, sql: str) -> DataFrame:
    """A SELECT over one streaming source that it calls `name`."""
    statement = parse(sql).statement
    if not isinstance(statement, A.Select):
        raise GeneralError("only SELECT runs over a stream")
    if statement.joins or statement.source.table != name:
        raise GeneralError(f"a stream query reads '{name}' only")
    if statement.limit is not None or statement.order is not None:
        raise NotImplementedFeature("ORDER BY and LIMIT over a stream are not supported")
    return Selection(statement, lambda ref, i: source(stream.sparkSession, "", ref, i, frame=stream)).frame()


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], *, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and keys; rows later than `late` are left out once their window is closed."""
    timed = stream.withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
