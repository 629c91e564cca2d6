"""Series from tables: long, wide, arrays, Arrow batches, CSV folders; and made-up ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES, POS, VALUE = "series_id", "pos", "v"


def _value(c: Column, nulls: str) -> Column:
    c = c.cast("double")
    if nulls == "fail":
        return F.when(c.isNull(), F.raise_error(F.lit("a series has a null value"))).otherwise(c)
    return F.coalesce(c, F.lit(0.0)) if nulls == "zero" else c


def from_long(df: DataFrame, series: str | Column, order: list, value: str | Column, nulls: str = "fail") -> DataFrame:
    """(series_id, pos, v) from rows: pos counts the rows of a series in the given order, which
    has to be total. nulls: fail, drop or zero."""
    if nulls not in ("fail", "drop", "zero"):
        raise ValueError(f"unknown treatment of nulls: {nulls!r}")
    series, value = (F.col(c) if isinstance(c, str) else c for c in (series, value))
    given = df.select(series.cast("string").alias(SERIES), _value(value, nulls).alias(VALUE), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)])
    if nulls == "drop":
        given = given.where(F.col(VALUE).isNotNull())
    place = F.row_number().over(Window.partitionBy(SERIES).orderBy(*[f"_o{k}" for k in range(len(order))])) - 1
    return given.select(SERIES, place.alias(POS), VALUE)


def from_wide(df: DataFrame, order: str, columns: list[str] | None = None, nulls: str = "fail") -> DataFrame:
    """Each column is a series; order numbers the rows."""
    columns = columns or [c for c in df.columns if c != order]
    long = df.select(F.col(f"`{order}`").alias("_order"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot("_order", columns, SERIES, "_value")
    return from_long(long, SERIES, ["_order"], "_value", nulls)


def from_arrays(df: DataFrame, series: str | Column, values: str | Column, nulls: str = "fail") -> DataFrame:
    """Each row's array is a series. No shuffle: positions are those in the array."""
    series, values = (F.col(c) if isinstance(c, str) else c for c in (series, values))
    if nulls == "drop":
        values = F.filter(values, lambda x: x.isNotNull())
    rows = df.select(series.cast("string").alias(SERIES), F.posexplode(values).alias(POS, "_value"))
    return rows.select(SERIES, POS, _value(F.col("_value"), nulls).alias(VALUE))


def from_arrow(spark: SparkSession, batch: pa.RecordBatch | pa.Table, nulls: str = "fail") -> DataFrame:
    """Each column of an Arrow batch is a series, in row order."""
    table = pa.table(batch) if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    names = table.column_names
    table = table.append_column("_row", pa.array(range(table.num_rows), pa.int64()))
    return from_wide(spark.createDataFrame(table), "_row", names, nulls)


def from_csv(spark: SparkSession, path: str, schema: str, order: str, columns: list[str], header: bool = True, nulls: str = "fail") -> DataFrame:
    """A folder of CSV files: each file's columns are series, named "file/column"."""
    files = spark.read.csv(path, schema=schema, header=header).withColumn("_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    long = files.unpivot(["_file", order], columns, "_column", "_value")
    return from_long(long, F.concat_ws("/", "_file", "_column"), [order], "_value", nulls)


def pad(frame: DataFrame, length: int, value: float = 0.0) -> DataFrame:
    """Series filled up to length with value; longer ones stay."""
    have = frame.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < length)
    more = have.select(SERIES, F.explode(F.sequence(F.col("_n").cast("int"), F.lit(length - 1))).alias(POS), F.lit(float(value)).alias(VALUE))
    return frame.unionByName(more)


def synthetic(spark: SparkSession, n_series: int, n_points: int, seed: int = 42) -> DataFrame:
    """Four kinds of series by turns: noise, sine, trend, random walk."""
    rows = spark.range(n_series * n_points).select((F.col("id") / n_points).cast("long").alias("s"), (F.col("id") % n_points).cast("int").alias(POS), F.randn(seed).alias("e"))
    t = F.col(POS) * (10.0 / max(1, n_points - 1))
    walk = F.sum("e").over(Window.partitionBy("s").orderBy(POS)) * 0.1
    kind = F.col("s") % 4
    v = F.when(kind == 0, F.col("e")).when(kind == 1, F.sin(t * 6.283185307179586) + F.col("e") * 0.5).when(kind == 2, t * 0.5 + F.col("e") * 0.5).otherwise(walk)
    return rows.select(F.col("s").cast("string").alias(SERIES), POS, v.alias(VALUE))
