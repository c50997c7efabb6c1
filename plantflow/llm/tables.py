"""Reading the given tables and writing what jobs share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.staging import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str = "t") -> str:
    """The path of a Parquet table of the shared folder that df is written to."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_stored(spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
    """Tables of one schema as one scan."""
    return spark.read.schema(schema).parquet(*paths)


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """df, computed once into a Parquet table of the shared folder and read from there."""
    return read_stored(df.sparkSession, df.schema, [stored(df, label)])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)
