"""SELECT statements of the dialect over Parquet tables that no database manages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessella.errors import GeneralError
from tessella.plans import ast as A
from tessella.plans.binder import Selection, Table, kind_of
from tessella.plans.parser import parse
from tessella.sources import files


def select(spark: SparkSession, folder: str, sql: str, params: list[Any] | None = None) -> DataFrame:
    """The result of one SELECT; table names are those of the Parquet tables below `folder`."""
    statement = parse(sql).statement
    if not isinstance(statement, A.Select):
        raise GeneralError("only SELECT runs over plain tables")
    return Selection(statement, lambda ref, i: source(spark, folder, ref, i), params).frame()


def source(spark: SparkSession, folder: str, ref: A.Source, position: int, frame: DataFrame | None = None) -> Table:
    """A Parquet table (or another DataFrame under its name) in scope; every column may be searched by words."""
    raw = files.parquet(spark, folder, ref.table) if frame is None else frame
    names = {c: f"_t{position}_{k}" for k, c in enumerate(raw.columns)}
    renamed = raw.toDF(*names.values())
    return Table(ref.scope, renamed, names, {f.name: kind_of(f) for f in raw.schema.fields}, lambda c: True, raw, None)
