"""Pivot, unpivot, level-ordered rows and contingency tables.

All inputs here are already aggregated (periods x groups), so the pivot's
value list is collected from a frame whose size is bounded by the number
of periods, never by the number of flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pivot_values(df: DataFrame, column: str) -> list:
    """Sorted distinct non-NULL values of ``column``: one per column of the pivoted result."""
    return [r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).orderBy(column).collect()]


def pivot_wide(df: DataFrame, ids: list[str], names_from: str, values_from: str,
               values: list | None = None) -> DataFrame:
    """Long -> wide: one column per value of ``names_from`` (sorted), missing
    cells NULL. Pass ``values`` to skip the distinct-values job; a row with
    another value then fails the query, so that none is lost in silence."""
    vals = values if values is not None else pivot_values(df, names_from)
    if values is not None:
        name = F.col(names_from)
        wrong = F.raise_error(F.concat(F.lit(f"{names_from} has a value without a column: "), name.cast("string")))
        df = df.withColumn(names_from, F.when(name.isNull() | name.isin(*vals), name).otherwise(wrong.cast(df.schema[names_from].dataType)))
    out = df.groupBy(*ids).pivot(names_from, vals).agg(F.first(values_from))
    return out.select(*ids, *[F.col(str(v)) for v in vals])


def unpivot_long(df: DataFrame, ids: list[str], cols: list[str], names_to: str = "name",
                 values_to: str = "value") -> DataFrame:
    """Wide -> long; NULL cells are kept as rows."""
    return df.unpivot(ids, cols, names_to, values_to)


def level_frame(spark: SparkSession, column: str, levels: list, dtype: T.DataType | None = None) -> DataFrame:
    """(column, <column>_ORDER) rows for a declared level order."""
    dtype = dtype or (T.StringType() if isinstance(levels[0], str) else T.LongType())
    schema = T.StructType([T.StructField(column, dtype), T.StructField(f"{column}_ORDER", T.IntegerType())])
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(levels)], schema)


def level_order_join(df: DataFrame, column: str, levels: list) -> DataFrame:
    """Rows of ``df`` in the given level order; a level with no row is a
    row of NULLs, a value outside the levels is dropped (positional lookup)."""
    lv = level_frame(df.sparkSession, column, levels, df.schema[column].dataType)
    # both sides are tiny (levels; one aggregated row per level): AQE picks
    # the join from runtime sizes, no hint needed
    out = lv.join(df, column, "left")
    return out.orderBy(f"{column}_ORDER").select(*df.columns, f"{column}_ORDER")


def contingency(df: DataFrame, row: str, column: str, row_levels: list, col_levels: list,
                name: str = "Freq") -> DataFrame:
    """Counts for every (row, column) level pair, zero cells included.

    The level grid is built from the two declared level lists (their
    product is tiny and fixed, e.g. 2 x 2 classes), then left-joined to
    the distributed counts.
    """
    spark = df.sparkSession
    grid_schema = T.StructType([T.StructField(row, df.schema[row].dataType),
                                T.StructField(column, df.schema[column].dataType)])
    grid = spark.createDataFrame([(a, b) for a in row_levels for b in col_levels], grid_schema)
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias(name))
    return (grid.join(counts, [row, column], "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))
            .orderBy(row, column))
