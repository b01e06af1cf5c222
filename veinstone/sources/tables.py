"""Tables by name, with enough partitions for the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import sound

#: A table of up to this many bytes may be one row group and so one task; moving it once is cheaper than that.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table to all cores; larger ones have splits enough and stay where they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sound(spark).read.parquet(f"{sf_dir}/{name}.parquet")
