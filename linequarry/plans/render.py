"""Records, sentinel lines and JSON documents made from result tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..operators.windows import Bounds


def record(*parts: str) -> Column:
    """``a:b:c`` of the named columns."""
    return F.concat_ws(":", *[F.col(p).cast("string") for p in parts]).alias("record")


def hit_records(hits: DataFrame, key: str) -> DataFrame:
    return hits.select(record(key, "line", "column", "preview"))


def sentinel(report: DataFrame, expression: str, ms: float = 0.0) -> DataFrame:
    """One JSON line about a finished search; no match is still ok."""
    files = F.struct(F.col("files_discovered").alias("discovered"), F.col("files_scanned").alias("scanned"), F.col("files_skipped").alias("skipped"))
    slow = F.struct(F.col("slowest_key").alias("key"), F.col("slowest_bytes").alias("bytes"))
    cut = [(F.col("shown") < F.col("matches")).alias("truncated")] if "shown" in report.columns else []
    return report.select(F.to_json(F.struct(F.lit("lq.result.v1").alias("type"), F.lit("ok").alias("status"), F.lit(expression).alias("expr"), F.col("matches"), F.col("bytes_scanned").alias("bytes"), files.alias("files"), F.lit(ms).alias("ms"), slow.alias("slowest"), *cut)).alias("line"))


def error_sentinel(error: QueryError) -> str:
    return json.dumps({"type": "lq.error.v1", "code": error.code, "message": str(error)}, ensure_ascii=False)


def search_json(report: DataFrame, hits: DataFrame, expression: str, key: str) -> DataFrame:
    """One row: the whole report with its (already limited) hits."""
    rows = hits.agg(F.array_sort(F.collect_list(F.struct(F.col(key), "line", "column", "preview"))).alias("hits"))
    stats = F.struct(*[F.col(c) for c in report.columns]).alias("stats")
    return report.crossJoin(F.broadcast(rows)).select(F.to_json(F.struct(F.lit(expression).alias("expression"), F.col("hits"), stats)).alias("json"))


def write_report(lines: DataFrame, path: str) -> None:
    """Overwrites ``path`` with one text file of the (few) lines."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def window_text(path: str, b: Bounds, lines: Sequence[tuple[int, str]], eof: bool) -> str:
    """Grouped text of one window (at most a few hundred lines), with the call that continues it."""
    width = len(str(lines[-1][0])) if lines else 1
    out = [f"== {path} [{b.label}]", *(f"{n:>{width}} | {s}" for n, s in lines)]
    nxt = None if eof else b.after(len(lines))
    if nxt is not None:
        args = ["inspect", path, "--range", f"{nxt.start}:{nxt.end}"] if nxt.end is not None else ["inspect", path, "--start-line", str(nxt.start), "--limit", str(nxt.limit)]
        out.append(json.dumps({"type": "lq.next.v1", "argv": args}))
    return "\n".join(out)


def context_text(path: str, rows: Sequence[tuple[int, str, str]]) -> str:
    width = len(str(rows[-1][0])) if rows else 1
    return "\n".join([f"== {path}", *(f"{n:>{width}} {'>' if role == 'match' else ' '} | {s}" for n, role, s in rows)])
