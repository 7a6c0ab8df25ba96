"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: later jobs start from files that survive a lost executor."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def prefixed(df: DataFrame, schema: str) -> T.StructType:
    """The columns of `df` followed by those of `schema`."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(schema).fields])


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have."""
    name, taken = wanted, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
