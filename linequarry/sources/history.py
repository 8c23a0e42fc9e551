"""Run histories as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, ts timestamp, profile string, expression string, corpus string, ms double, ref_ms double, speedup_pct double, hotspot string, match_count long, "
    "files_scanned long, files_skipped long, phase struct<discover: double, scan: double, aggregate: double, total: double>, "
    "competitors map<string, struct<available: boolean, duration_ms: double, authority: string>>, slowest array<struct<path: string, ms: double, bytes: long>>"
)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A malformed line is an error; blank lines do not count."""
    return flatten(spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path))


def flatten(runs: DataFrame) -> DataFrame:
    """Phases as columns, as the run statistics expect them."""
    return runs.withColumns({f"{p}_ms": F.col(f"phase.{p}") for p in ("discover", "scan", "aggregate", "total")})


def append(runs: DataFrame, path: str, latest: str | None = None) -> None:
    """Adds records to the history; ``latest`` is overwritten with the last one in time."""
    runs.write.mode("append").json(path)
    if latest is not None:
        runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(1).coalesce(1).write.mode("overwrite").json(latest)
