"""Columnar tables in Parquet: write, read, project, filter and aggregate single columns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ColumnarTable:
    """A table of whole-number, floating and text columns at a path. Every operation is one scan of the columns that it
    names, with its filter pushed down."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> ColumnarTable:
        """sort_by clusters rows inside files, so that row-group bounds prune."""
        out = df.sortWithinPartitions(*sort_by) if sort_by else df
        out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return cls(df.sparkSession, path)

    def scan(self, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.select(*columns) if columns else df

    def append(self, rows: DataFrame) -> None:
        rows.select(*self.scan().columns).write.mode("append").parquet(self.path)

    def filter_eq(self, column: str, value: Any) -> DataFrame:
        return self.scan().where(F.col(column) == value)

    def filter_gt(self, column: str, value: Any) -> DataFrame:
        return self.scan().where(F.col(column) > value)

    def _numbers(self, column: str) -> Column:
        return F.col(column).try_cast("double")

    def sum(self, column: str) -> float:
        """0 where there is nothing to add."""
        return self.scan(column).agg(F.sum(self._numbers(column))).first()[0] or 0.0

    def avg(self, column: str) -> float:
        """The sum over all rows, those without a number too."""
        total, n = self.scan(column).agg(F.sum(self._numbers(column)), F.count(F.lit(1))).first()
        if not n:
            raise ValueError("no rows")
        return (total or 0.0) / n

    def min(self, column: str) -> float:
        return self._bound(column, F.min)

    def max(self, column: str) -> float:
        return self._bound(column, F.max)

    def _bound(self, column: str, f: Any) -> float:
        got = self.scan(column).agg(f(self._numbers(column))).first()[0]
        if got is None:
            raise ValueError("no numbers")
        return got


def to_arrow(df: DataFrame):  # noqa: ANN201
    """An Arrow table on the driver, for results that fit there."""
    return df.toArrow()


def from_arrow(spark: SparkSession, table) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(table)
