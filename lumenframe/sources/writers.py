"""Writing results, named tables and run history."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.columns import col


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def export_all_tables(spark: SparkSession, names: Sequence[str], folder: str, format: str = "parquet") -> list[str]:
    """Each named table to its own directory below ``folder``."""
    paths = []
    for name in names:
        writer = spark.table(name).write.format(format)
        paths.append(f"{folder.rstrip('/')}/{name}")
        (writer.option("header", True) if format == "csv" else writer).save(paths[-1])
    return paths


def save_as_table(df: DataFrame, name: str, persistent: bool = False) -> DataFrame:
    """Create or replace a named table: a view of the query, or a stored table if ``persistent``."""
    if persistent:
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def drop_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    dropped = []
    for name in names:
        if spark.catalog.dropTempView(name):
            dropped.append(name)
        elif spark.catalog.tableExists(name):
            spark.sql(f"DROP TABLE `{name}`")
            dropped.append(name)
    return dropped


HISTORY = T.StructType(
    [
        T.StructField("at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("features", T.ArrayType(T.StringType())),
    ]
)


def append_history(spark: SparkSession, path: str, record: Mapping) -> None:
    """Add one run (query or model) to a history table kept as parquet at ``path``."""
    row = (
        record.get("at") or datetime.datetime.now(datetime.timezone.utc),
        record.get("kind", "query"),
        record.get("text"),
        {k: float(v) for k, v in (record.get("metrics") or {}).items()},
        list(record.get("features") or []),
    )
    spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("append").parquet(path)


def latest_runs(history: DataFrame, n: int = 10) -> DataFrame:
    return history.orderBy(F.desc("at")).limit(n)


def metric_over_time(history: DataFrame, name: str) -> DataFrame:
    return history.select("at", "kind", col("metrics")[name].alias("value")).filter(F.col("value").isNotNull()).orderBy("at")
