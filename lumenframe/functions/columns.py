"""Which columns are numeric, text or temporal, read from the schema without touching data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def classify_columns(df: DataFrame) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            kinds["categorical"].append(field.name)
        elif isinstance(field.dataType, TEMPORAL):
            kinds["datetime"].append(field.name)
        else:
            kinds["other"].append(field.name)
    return kinds


def numeric_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return list(cols) if cols is not None else classify_columns(df)["numeric"]


def text_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    if cols is not None:
        return list(cols)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def all_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    return list(cols) if cols is not None else list(df.columns)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, so that one notion of 'missing' holds everywhere after reading."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floats:
        return df
    return df.select(
        *[F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns]
    )


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the named columns and keeps the order of the others."""
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def unit_draw(key, seed: int = 42) -> Column:
    """Repeatable number in [0, 1) per key, the same on any engine: the first 32 bits of an MD5."""
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
