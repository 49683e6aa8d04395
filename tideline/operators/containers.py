"""Copying, dropping, resetting and combining columns of a stream; selecting detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.flags import raised


def copy(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """New columns with the values of existing ones: {from: to}."""
    return df.withColumns({to: F.col(of) for of, to in columns.items()})


def delete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def reset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero for numbers and false for booleans, the empty string for strings, null for the rest."""

    def blank(kind: T.DataType) -> Column:
        if isinstance(kind, T.NumericType):
            return F.lit(0).cast(kind)
        return F.lit("") if isinstance(kind, T.StringType) else F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None).cast(kind)

    return df.withColumns({c: blank(df.schema[c].dataType) for c in columns})


def _quotient(a: Column, b: Column) -> Column:
    """Of floating numbers: infinite or NaN where b is zero, which Spark's own division takes for an error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


_OPS = {"add": Column.__add__, "subtract": Column.__sub__, "multiply": Column.__mul__, "divide": _quotient}


def combine(df: DataFrame, op: str, first: str, second: str, result: str, scale: float = 1.0) -> DataFrame:
    """result = first (op) scale * second, both columns of one stream."""
    return df.withColumn(result, _OPS[op](F.col(first), F.lit(scale) * F.col(second)))


def combine_streams(a: DataFrame, b: DataFrame, op: str, keys: Sequence[str] = ("det", "i"), value: str = "signal", result: str = "result") -> DataFrame:
    """The same of two streams, for the samples that both have."""
    other = b.select(*keys, F.col(value).alias("__second"))
    return a.join(other, list(keys)).withColumn(result, _OPS[op](F.col(value), F.col("__second"))).drop("__second")


def calibrate(df: DataFrame, cal: DataFrame, bit: int = 1, key: str = "det", factor: str = "cal", value: str = "signal") -> DataFrame:
    """Signals times their detector's factor; a detector without one keeps its signal and is flagged."""
    table = cal.select(key, F.col(factor).alias("__c"))
    out = df.join(table, key, "left")
    return out.withColumns({value: F.col(value) * F.coalesce("__c", F.lit(1.0)), "flags": raised("flags", F.col("__c").isNull(), bit)}).drop("__c")


def memory_counter(df: DataFrame) -> DataFrame:
    """Bytes that the columns' values take, as one row."""

    def width(f: T.StructField) -> Column:
        fixed = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}.get(type(f.dataType), 8)
        return F.octet_length(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.lit(fixed)

    total = sum((F.sum(F.when(F.col(f.name).isNotNull(), width(f)).otherwise(0)) for f in df.schema.fields), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("long").alias("n_bytes"))


def decimate_focalplane(dets: DataFrame, nskip: int = 10, pixel: str = "pix", bit: int = 1) -> DataFrame:
    """Flags all detectors but those of every ``nskip``-th pixel in the order of names."""
    rank = dets.select(pixel).distinct().withColumn("__r", F.row_number().over(W.orderBy(pixel)))
    flag = F.when((F.col("__r") - 1) % nskip == 0, 0).otherwise(bit)
    return dets.join(F.broadcast(rank), pixel).withColumn("det_flag", flag.cast("int")).drop("__r")


def yield_cut(dets: DataFrame, keep: float = 0.9, key: str = "pix", realization: int = 0, bit: int = 1) -> DataFrame:
    """Flags detectors at random: a uniform number made from the pixel's name decides, so a rerun decides alike."""
    digest = F.substring(F.md5(F.concat(F.col(key), F.lit(f"/{realization}"))), 1, 8)
    u = F.conv(digest, 16, 10).cast("long") / float(1 << 32)
    return dets.withColumn("det_flag", F.when(u < keep, 0).otherwise(bit).cast("int"))


def select_data(df: DataFrame, **columns: str) -> DataFrame:
    """Rows whose columns match regular expressions from their start."""
    for name, pattern in columns.items():
        df = df.where(F.col(name).cast("string").rlike(f"^(?:{pattern})"))
    return df


def split_data(df: DataFrame, key: str) -> DataFrame:
    """Sizes of the parts that a split by a column would give."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("det").alias("n_dets"))
