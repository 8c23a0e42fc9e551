"""Search roots: one comparable key each, no repeats, none inside another."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root_key(path: str) -> str:
    """Forward slashes, lower case, no slash at the end."""
    return path.replace("\\", "/").lower().rstrip("/") or "/"


def classify(paths: Sequence[str]) -> list[tuple[str, bool]]:
    return [(p, os.path.isdir(p)) for p in (paths or ["."])]


def prune_roots(spark: SparkSession, roots: Sequence[tuple[str, bool]]) -> DataFrame:
    """key, is_directory of the roots that remain (a list of command-line arguments, so small)."""
    rows = spark.createDataFrame([(root_key(p), d) for p, d in roots], "key string, is_directory boolean").groupBy("key").agg(F.max("is_directory").alias("is_directory"))
    inside = rows.where("is_directory").select(F.col("key").alias("parent"))
    prefix = F.when(F.col("parent") == "/", "/").otherwise(F.concat("parent", F.lit("/")))
    return rows.join(F.broadcast(inside), F.col("key").startswith(prefix) & (F.col("key") != F.col("parent")), "left_anti")
