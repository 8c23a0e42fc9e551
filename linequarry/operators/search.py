"""Search over a table of texts: hits, counts, reports, pruning, candidate sets.

A corpus is any DataFrame with key columns and a text column.  Lines are split
at ``\\n`` only, all trailing ``\\r`` go, numbers start at 1, and a final ``\\n``
leaves one empty line.  Document-level tests run before the split, so lines
are made of admitted documents only; each line is then verified in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.columns import as_plan, counts_whole_text, line_column, line_count, line_test, may_match, needs_python, trigram_test
from ..functions.expr import Plan

MAX_HITS = 4096  # what the command line asks for by default; any other number goes through


def is_binary(text: Column) -> Column:
    """A NUL among the first 1024 characters."""
    return F.instr(F.substring(text, 1, 1024), "\u0000") > 0


def lines_of(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, line (long), content; one row per line."""
    pieces = F.posexplode(F.split(F.col(text), "\n", -1)).alias("_at", "_raw")
    return docs.select(*keys, pieces).select(*keys, (F.col("_at") + 1).cast("long").alias("line"), F.rtrim("_raw", F.lit("\r")).alias("content"))


def admitted(docs: DataFrame, query: str | Plan, text: str = "text", fold: bool = False, prefilter: bool = True, raw: bool = False) -> DataFrame:
    test = may_match(query, F.col(text), fold, raw=raw) if prefilter else None
    return docs if test is None else docs.where(test)


def searchable(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.where(F.col(text).isNotNull() & ~is_binary(F.col(text)))


def hits(docs: DataFrame, query: str | Plan, keys: Sequence[str] = ("doc_id",), text: str = "text", fold: bool = False, prefilter: bool = True, max_hits: int | None = None, raw: bool = False) -> DataFrame:
    """keys, line, column, preview of every matching line (raw: the text is a byte view); ``max_hits`` keeps the first ones by key and line."""
    plan = as_plan(query)
    rows = lines_of(admitted(searchable(docs, text), plan, text, fold, prefilter, raw), keys, text).where(line_test(plan, F.col("content"), fold, raw))
    out = rows.select(*keys, "line", line_column(plan, F.col("content"), fold, raw).cast("long").alias("column"), F.col("content").alias("preview"))
    return out if max_hits is None else out.orderBy(*keys, "line").limit(max_hits)


def matching_lines(docs: DataFrame, query: str | Plan, keys: Sequence[str] = ("doc_id",), text: str = "text", fold: bool = False, prefilter: bool = True) -> DataFrame:
    """keys, matches: number of matching lines of each document that has any."""
    rows = lines_of(admitted(searchable(docs, text), query, text, fold, prefilter), keys, text)
    return rows.where(line_test(query, F.col("content"), fold)).groupBy(*keys).agg(F.count("*").alias("matches"))


def count_matches(docs: DataFrame, query: str | Plan, text: str = "text", fold: bool = False, prefilter: bool = True, raw: bool = False) -> DataFrame:
    """One row: matches (occurrences for one literal or full regular expression, else matching lines).

    A literal is counted on whole texts without a split.
    """
    plan, some = as_plan(query), admitted(searchable(docs, text), query, text, fold, prefilter, raw)
    if counts_whole_text(plan):
        counted = some.select(line_count(plan, F.col(text), fold, raw).alias("n"))
    else:
        counted = lines_of(some, [], text).select(line_count(plan, F.col("content"), fold, raw).alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("matches"))


def _matching(docs: DataFrame, plan: Plan, columns: dict[str, Column], text: str, fold: bool = False, raw: bool = False) -> DataFrame:
    """``columns`` of each document and n, its number of matching lines (where ``admit`` holds)."""
    pieces = F.split(F.col(text), "\n", -1)
    if not needs_python(plan):
        n = F.size(F.filter(pieces, lambda x: line_test(plan, F.rtrim(x, F.lit("\r")), fold, raw)))
        return docs.select(*[c.alias(k) for k, c in columns.items()], F.when(columns["admit"], n).otherwise(0).alias("n"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[c.alias(k) for k, c in columns.items()], F.explode(pieces).alias("_line"))
    rows = rows.withColumn("_n", (F.col("admit") & line_test(plan, F.rtrim("_line", F.lit("\r")), fold, raw)).cast("int"))
    return rows.groupBy("_row").agg(*[F.first(k).alias(k) for k in columns], F.sum("_n").alias("n")).drop("_row")


def report(docs: DataFrame, query: str | Plan, key: str = "doc_id", text: str = "text", fold: bool = False, raw: bool = False) -> DataFrame:
    """One row of counters; pruned documents count as scanned, binary ones as skipped. The slowest one is the largest, of equal ones that with the least key (of any type)."""
    plan = as_plan(query)
    test = may_match(plan, F.col(text), fold, raw=raw)
    admit = F.lit(True) if test is None else test
    size = (F.length(text) if raw else F.octet_length(text)).cast("long")
    columns = {"k": F.col(key), "bytes": size, "skip": is_binary(F.col(text)), "admit": admit}
    per = _matching(docs.where(F.col(text).isNotNull()), plan, columns, text, fold, raw)
    ok = ~F.col("skip")
    largest = F.min(F.when(ok, F.struct((-F.col("bytes")).alias("bytes"), F.col("k"))))
    return per.agg(
        F.count("*").alias("files_discovered"), F.count_if(ok).alias("files_scanned"), F.count_if("skip").alias("files_skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes_scanned"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).cast("long").alias("matches"),
        F.count_if(ok & (F.col("n") > 0)).alias("files_matched"), F.count_if(ok & ~F.col("admit")).alias("files_pruned"),
        F.coalesce(F.sum(F.when(ok & ~F.col("admit"), F.col("bytes"))), F.lit(0)).alias("bytes_pruned"), largest.alias("l"),
    ).select("*", F.col("l.k").alias("slowest_key"), (-F.col("l.bytes")).alias("slowest_bytes")).drop("l")


def prune_stats(docs: DataFrame, query: str | Plan, text: str = "text") -> DataFrame:
    """One row: what trigram admission checked, pruned and left to verify, and how many of these matched."""
    plan = as_plan(query)
    test = trigram_test(plan, F.col(text))
    admit = F.lit(True) if test is None else test
    per = _matching(searchable(docs, text), plan, {"admit": F.lit(True), "a": admit, "b": F.octet_length(text).cast("long")}, text).withColumn("m", F.col("n") > 0)
    return per.agg(
        F.lit(test is not None).alias("eligible"), F.count("*").alias("checked"), F.count_if(~F.col("a")).alias("pruned"), F.coalesce(F.sum(F.when(~F.col("a"), F.col("b"))), F.lit(0)).alias("pruned_bytes"),
        F.count_if("a").alias("verified"), F.count_if(F.col("a") & F.col("m")).alias("matched"), F.count_if(~F.col("a") & F.col("m")).alias("lost"),
    )


def candidates(docs: DataFrame, query: str | Plan, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Keys of the documents that may match."""
    return admitted(searchable(docs, text), query, text).select(*keys)


def search_candidates(docs: DataFrame, chosen: DataFrame, query: str | Plan, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Hits among the chosen documents only (a left semi join by key)."""
    return hits(docs.join(chosen.select(*keys).distinct(), list(keys), "left_semi"), query, keys, text)


def trigram_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted table (trigram, key) over the byte view; for corpora that are searched often."""
    raw = F.encode(F.col(text), "UTF-8")  # substrings of binary values do not scan
    some = searchable(docs, text).where(F.octet_length(text) >= 3).select(F.col(key), raw.alias("_b"))
    spots = some.select(key, "_b", F.explode(F.sequence(F.lit(1), F.octet_length("_b") - 2)).alias("_i"))
    return spots.select(F.decode(F.substring("_b", F.col("_i"), F.lit(3)), "ISO-8859-1").alias("trigram"), key).distinct()


def divide(index: DataFrame, query: str | Plan, key: str = "doc_id") -> DataFrame:
    """Keys that hold all trigrams of every predicate of an AND query, or of any predicate of an OR query (relational division on the index).

    In an AND query predicates without a trigram leave the choice to the others;
    a query that no trigram decides is an error, since the index can't rule out any key.
    """
    from ..functions.evidence import admit

    plan = as_plan(query)
    admission = admit(plan)
    if not admission.eligible:
        raise QueryError("not_indexed", f"no trigram decides this query: {admission.reason}")
    groups = [{t.decode("latin-1") for t in group} for _, group in admission.groups]
    if plan.mode != "any":
        groups = [set().union(*groups)]
    held = [F.count_if(F.col("trigram").isin(sorted(g))) == len(g) for g in groups]
    whole = held[0]
    for more in held[1:]:
        whole = whole | more
    some = index.where(F.col("trigram").isin(sorted(set().union(*groups)))).select(key, "trigram").distinct()
    return some.groupBy(key).agg(whole.alias("_holds")).where("_holds").select(key)
