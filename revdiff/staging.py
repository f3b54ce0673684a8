"""Intermediate tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from revdiff.session import checkpoint_dir


def stage(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    Steps that use a frame more than once would each recompute all that lies above it. The table
    cuts that lineage, outlives a lost executor, and tells the planner its size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/revdiff-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
