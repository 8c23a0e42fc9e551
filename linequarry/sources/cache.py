"""Candidate sets of earlier searches, kept as a small table and checked before use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import as_plan, may_match
from ..functions.expr import Plan


def cache_key(query: str | Plan, name: str) -> str:
    import hashlib

    return hashlib.sha256(f"{as_plan(query).source}\n{name}".encode()).hexdigest()[:32]


def signature(docs: DataFrame, keys: Sequence[str], content: Sequence[str]) -> str:
    """Order-free digest of the keys and of what stands for the content (length and time, or the text)."""
    row = docs.agg(F.count("*"), F.sum(F.xxhash64(*keys, *content).cast("decimal(38,0)")), F.sum(F.hash(*keys, *content).cast("long"))).first()
    return ":".join(map(str, row))


def build(docs: DataFrame, query: str | Plan, path: str, name: str, keys: Sequence[str], content: Sequence[str], text: str = "text") -> bool:
    """Writes the candidates below ``path``; False if the query allows no pruning."""
    test = may_match(query, F.col(text))
    if test is None:
        return False
    key, sig = cache_key(query, name), signature(docs, keys, content)
    docs.where(test).select(*keys).withColumns({"cache_key": F.lit(key), "signature": F.lit(sig)}).write.mode("overwrite").parquet(f"{path}/{key}")
    docs.sparkSession.createDataFrame([(key, sig)], "cache_key string, signature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{key}.head")
    return True


def load(spark: SparkSession, docs: DataFrame, query: str | Plan, path: str, name: str, keys: Sequence[str], content: Sequence[str]) -> DataFrame | None:
    """The candidates, or None where there are none or the corpus has changed since."""
    key = cache_key(query, name)
    try:
        head = spark.read.parquet(f"{path}/{key}.head").first()
        found = spark.read.parquet(f"{path}/{key}")
    except AnalysisException:
        return None
    if head is None or head["cache_key"] != key or head["signature"] != signature(docs, keys, content):
        return None
    return found.where(F.col("signature") == head["signature"]).select(*keys)


def admit(docs: DataFrame, found: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    return docs if found is None else docs.join(found, list(keys), "left_semi")
