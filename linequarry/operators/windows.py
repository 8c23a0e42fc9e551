"""Windows of lines, and matching lines with context."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.columns import as_plan, line_test, may_match
from ..functions.expr import Plan
from .search import lines_of

DEFAULT_LIMIT, MAX_WINDOW = 240, 512


@dataclass(frozen=True)
class Bounds:
    start: int
    end: int | None  # inclusive
    limit: int | None
    total: bool = False
    everything: bool = False

    @property
    def label(self) -> str:
        return f"{self.start}:{self.end}" if self.end is not None else f"{self.start}:+{self.limit}" if self.limit is not None else f"{self.start}:*"

    @property
    def last(self) -> int:
        """Last line that the window may show."""
        ends = [self.start + MAX_WINDOW - 1]
        if self.end is not None:
            ends.append(self.end)
        if self.limit is not None:
            ends.append(self.start + self.limit - 1)
        return min(ends)

    def after(self, shown: int) -> Bounds | None:
        """Where to go on after ``shown`` lines, if the window can be continued."""
        if self.everything or self.total:
            return None
        if self.end is not None:
            span = self.end - self.start + 1
            return Bounds(self.end + 1, self.end + span, None) if shown == span else None
        return Bounds(self.start + self.limit, None, self.limit) if self.limit is not None else None


def bounds(skip: int | None = None, limit: int | None = None, start: int | None = None, end: int | None = None, range_: str | None = None, total: bool = False, everything: bool = False) -> Bounds:
    """Checks which options go together and fills in the rest."""

    def bad(why):
        raise QueryError("bad_window", why)

    given = [x is not None for x in (skip, limit, start, end)]
    if range_ is not None:
        if any(given) or total or everything:
            bad("a range goes with no other window option")
        a, colon, b = range_.partition(":")
        if not (colon and a.isdigit() and b.isdigit() and 1 <= int(a) <= int(b)):
            bad("a range is a:b with 1 <= a <= b")
        return Bounds(int(a), int(b), None)
    if total:
        if any((given[0], given[1], given[2], given[3])) or everything:
            bad("a total count goes with no window option")
        return Bounds(1, None, None, total=True)
    if skip is not None and start is not None:
        bad("skip and start exclude each other")
    if any(x is not None and x < 1 for x in (limit, start, end)) or (skip is not None and skip < 0):
        bad("window options are positive")
    first = start or (skip or 0) + 1
    if end is not None and end < first:
        bad("the window ends before it starts")
    if limit is None and end is None and not everything:
        limit = DEFAULT_LIMIT
    return Bounds(first, end, limit, everything=everything)


def window(docs: DataFrame, b: Bounds, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, number, content of the lines inside the bounds; a final line end adds no line here."""
    return _own_lines(docs, keys, text).where(F.col("number").between(b.start, b.last))


def _own_lines(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    body = F.when(F.col(text).endswith("\n"), F.expr(f"left(`{text}`, length(`{text}`) - 1)")).otherwise(F.col(text))
    some = docs.where((F.col(text) != "") & F.col(text).isNotNull()).select(*keys, body.alias("_body"))
    return lines_of(some, keys, "_body").withColumnRenamed("line", "number")


def window_report(docs: DataFrame, b: Bounds, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, label, start, end, shown, eof, total (known at the end of the text or when asked for)."""
    size = F.when((F.col(text) == "") | F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1)) - F.col(text).endswith("\n").cast("int"))
    shown = F.greatest(F.lit(0), F.least(F.col("_n"), F.lit(b.last)) - b.start + 1)
    shown = F.lit(0) if b.total else shown
    eof = F.lit(True) if b.total else F.col("_n") <= b.last
    out = docs.select(*keys, size.alias("_n"))
    return out.select(
        *keys, F.lit(b.label).alias("label"), F.lit(b.start).cast("long").alias("start"), (shown + b.start - 1).cast("long").alias("end"), shown.cast("long").alias("shown"),
        eof.alias("eof"), F.when(eof, F.col("_n").cast("long")).alias("total"),
    )


def context(docs: DataFrame, query: str | Plan, before: int = 2, after: int = 2, keys: Sequence[str] = ("doc_id",), text: str = "text", first_lines: int | None = None, raw: bool = False) -> DataFrame:
    """keys, line, role (match or context), content: matching lines with those around them, each line once."""
    plan = as_plan(query)
    test = may_match(plan, F.col(text), raw=raw)
    rows = lines_of(docs if test is None else docs.where(test), keys, text)
    if first_lines is not None:
        rows = rows.where(F.col("line") <= first_lines)
    rows = rows.withColumn("_m", line_test(plan, F.col("content"), raw=raw))
    near = W.partitionBy(*keys).orderBy("line").rowsBetween(-after, before)
    rows = rows.withColumn("_near", F.max("_m").over(near)).where("_near")
    return rows.select(*keys, "line", F.when(F.col("_m"), "match").otherwise("context").alias("role"), "content")
