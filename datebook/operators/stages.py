"""Steps of a long row-wise pipeline, written once and read again."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again.

    A stage ends an expression tree: what later steps name often is a column of a scan, not a formula
    that the optimiser copies into each place.  It also ends lineage, so a lost executor costs one stage.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
