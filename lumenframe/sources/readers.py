"""Reading tables and text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.columns import col, nan_to_null, unit_draw
from lumenframe.operators.schema import table_name


def read_table(spark: SparkSession, path: str, format: str | None = None, schema=None) -> DataFrame:
    """CSV, parquet, JSON or ORC; the format follows the file ending unless given. NaN reads as null.

    Without ``schema`` CSV types are inferred, which costs one more pass over the file.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    format = format or (ending if ending in ("parquet", "json", "orc") else "csv")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if format == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return nan_to_null(reader.format(format).load(path))


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as string: no inference pass."""
    return spark.read.option("header", True).csv(path)


def preview(df: DataFrame, n: int = 10_000) -> DataFrame:
    return df.limit(n)


def read_csv_encoded(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """The first encoding that decodes every row without a replacement character, else the last one."""
    for encoding in encodings[:-1]:
        lines = spark.read.option("encoding", encoding).option("sep", "\x01").csv(path)
        bad = lines.filter(F.col(lines.columns[0]).contains("�")).limit(1).count()
        if not bad:
            return _csv(spark, path, encoding)
    return _csv(spark, path, encodings[-1])


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return nan_to_null(spark.read.option("header", True).option("inferSchema", True).option("encoding", encoding).csv(path))


def read_sampled(spark: SparkSession, path: str, fraction: float, key: str | Sequence[str], seed: int = 42, format: str | None = None) -> DataFrame:
    """The rows whose draw by ``key`` is below ``fraction``: the same rows in every run and on any number of executors."""
    return read_table(spark, path, format).where(unit_draw(key, seed) < fraction)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per non-blank line of a text file."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter(F.trim("text") != "")


def text_lines(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank line of a text column; ``keep`` names columns to carry along."""
    lines = F.filter(F.split(col(column), "\r\n|\r|\n"), lambda line: F.trim(line) != "")
    return df.select(*[col(k) for k in keep], F.explode(lines).alias("text"))


def register_tables(spark: SparkSession, files: Mapping[str, str] | Sequence[str]) -> list[str]:
    """Files as named views; names come from the file names unless given."""
    named = files if isinstance(files, Mapping) else {table_name(f): f for f in files}
    for name, path in named.items():
        read_table(spark, path).createOrReplaceTempView(table_name(name))
    return [table_name(n) for n in named]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """struct image(origin, height, width, nChannels, mode, data) per file, decoded in the JVM."""
    return spark.read.format("image").option("dropInvalid", True).load(path)
