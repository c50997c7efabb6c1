"""Tables that are written once and read by later jobs, in a folder all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of the warehouse, or a temporary one if Spark runs on this machine alone."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        alone = context.master.split("[")[0] == "local"
        named = tempfile.mkdtemp(prefix="spark-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_staging"
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, label: str = "table") -> DataFrame:
    """df, computed once into a Parquet table of the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
