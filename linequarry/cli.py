"""Command line: search, matches, inspect, explain, or a bare pattern with grep-like flags."""

from __future__ import annotations

import argparse
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.expr import parse
from .operators import search as se
from .operators import windows as wi
from .plans import render
from .plans.explain import explain_json
from .sources.files import file_texts, list_files, read_files

COMMANDS = ("search", "matches", "inspect", "explain")
TAGS = ("lit:", "re:", "prefix:", "suffix:")


def lower_pattern(pattern: str, fixed: bool, fold: bool) -> str:
    """A grep-like pattern as a predicate."""
    if not fixed and not fold and pattern.startswith(TAGS):
        return pattern
    if not fixed:
        if "&&" in pattern or "||" in pattern:
            raise QueryError("ambiguous_pattern", "a raw pattern with && or || needs -F or a tag")
        return f"re:(?i){pattern}" if fold else f"re:{pattern}"
    if fold or "&&" in pattern or "||" in pattern:
        safe = re.sub(r"([\\.^$*+?()\[\]{}|])", r"\\\1", pattern).replace("&&", r"&\x26")
        return f"re:(?i){safe}" if fold else f"re:{safe}"
    return f"lit:{pattern}"


def lower_patterns(patterns, fixed: bool, fold: bool) -> str:
    return " || ".join(lower_pattern(p, fixed, fold) for p in patterns)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linequarry", description="Exact line search on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "matches"):
        s = sub.add_parser(name, help="hits or counts of a query")
        s.add_argument("expression")
        s.add_argument("paths", nargs="*", default=["."])
        s.add_argument("-i", "--ignore-case", action="store_true")
        s.add_argument("--hidden", action="store_true")
        s.add_argument("--max-hits", type=int, default=se.MAX_HITS)
        s.add_argument("--stats-only", action="store_true")
        s.add_argument("-j", "--json", action="store_true")
        s.add_argument("--emit-report")
        s.add_argument("--threads", type=int, help="at most this many tasks read files at a time")
        s.add_argument("-F", "--fixed-strings", action="store_true", help="accepted")
        s.add_argument("-n", "--line-number", action="store_true", help="accepted")
        s.add_argument("--follow-symlinks", action="store_true", help="accepted")
    s = sub.add_parser("inspect", help="lines of files, or matches with context")
    s.add_argument("paths", nargs="+")
    s.add_argument("--expr")
    for flag in ("--skip", "--limit", "--start-line", "--end-line"):
        s.add_argument(flag, type=int)
    s.add_argument("--range")
    s.add_argument("--total-count", "--head", action="store_true")
    s.add_argument("--all", action="store_true")
    s.add_argument("-B", "--before", type=int)
    s.add_argument("-A", "--after", type=int)
    s.add_argument("-C", "--context", type=int, default=2)
    s.add_argument("--hidden", action="store_true")
    s.add_argument("-j", "--json", action="store_true")
    s.add_argument("--records", action="store_true")
    s = sub.add_parser("explain", help="what a query means")
    s.add_argument("expression")
    return p


def translate(argv: list[str]) -> list[str]:
    """A bare pattern with grep-like flags as a search command."""
    p = argparse.ArgumentParser(prog="linequarry", add_help=False)
    p.add_argument("-e", "--regexp", action="append", default=[])
    p.add_argument("-F", "--fixed-strings", action="store_true")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-j", "--threads", type=int)
    p.add_argument("-n", "--line-number", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("rest", nargs="*")
    try:
        a = p.parse_args(argv)
    except SystemExit:
        raise QueryError("unsupported_flag", "this flag is not supported; see --help") from None
    patterns, paths = (a.regexp, a.rest) if a.regexp else (a.rest[:1], a.rest[1:])
    if not patterns:
        raise QueryError("missing_pattern", "a pattern is needed")
    out = ["search", lower_patterns(patterns, a.fixed_strings, a.ignore_case), *(paths or ["."])]
    return out + ["--json"] * a.json + ["--hidden"] * a.hidden + (["--threads", str(a.threads)] if a.threads else [])


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    """Output lines of one call."""
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv = translate(argv)
    a = parser().parse_args(argv)
    if a.command == "explain":
        return [explain_json(a.expression)]
    if a.command == "inspect":
        return _inspect(spark, a)
    plan = parse(a.expression)
    began = time.monotonic()
    docs = file_texts(read_files(spark, a.paths, a.hidden))
    if a.threads and a.threads > 0:
        docs = docs.coalesce(a.threads)
    skipped = list_files(a.paths, a.hidden)[1]
    if a.command == "matches" or a.stats_only:
        n = se.count_matches(docs, plan, fold=a.ignore_case, raw=True).first()["matches"]
        return [f'{{"type": "lq.count.v1", "matches": {n}}}']
    report = se.report(docs, plan, "path", fold=a.ignore_case, raw=True).withColumn("files_skipped", F.col("files_skipped") + skipped)
    hits = _readable(se.hits(docs, plan, ["path"], fold=a.ignore_case, max_hits=a.max_hits, raw=True), "preview")
    if a.json:
        lines = [r.json for r in render.search_json(report, hits, plan.source, "path").collect()]
    else:
        lines = [r.record for r in render.hit_records(hits, "path").collect()]
        shown = len(lines)
        lines += [r.line for r in render.sentinel(report.withColumn("shown", F.lit(shown)), plan.source, round((time.monotonic() - began) * 1000, 3)).collect()]
    if a.emit_report:
        with open(a.emit_report, "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return lines


def _readable(rows, column):
    """A byte view as text where it is valid UTF-8, else as it is."""
    return rows.withColumn(column, F.coalesce(F.try_validate_utf8(F.encode(column, "ISO-8859-1").cast("string")), F.col(column)))


def _inspect(spark, a) -> list[str]:
    out = []
    for path in a.paths:
        docs = file_texts(read_files(spark, [path], a.hidden))
        if a.expr:
            before = a.context if a.before is None else a.before
            after = a.context if a.after is None else a.after
            rows = _readable(wi.context(docs, a.expr, before, after, ["path"], raw=True), "content")
            if a.json:
                out += rows.select(F.to_json(F.struct("path", "line", "role", "content")).alias("j")).toPandas()["j"].tolist()
            elif a.records:
                out += rows.orderBy("path", "line").select(render.record("path", "line", "role", "content")).toPandas()["record"].tolist()
            else:
                out.append(render.context_text(path, [(r.line, r.role, r.content) for r in rows.orderBy("path", "line").toLocalIterator()]))
            continue
        b = wi.bounds(a.skip, a.limit, a.start_line, a.end_line, a.range, a.total_count, a.all)
        head = wi.window_report(docs, b, ["path"]).first()
        rows = [] if b.total or head is None else [(r.number, r.content) for r in _readable(wi.window(docs, b, ["path"]), "content").orderBy("number").collect()]
        if a.json:
            import json

            out.append(json.dumps({"path": path, "requested": b.label, "eof": bool(head and head.eof), "total": head.total if head else 0, "lines": [{"number": n, "text": s} for n, s in rows]}, ensure_ascii=False))
        elif a.records:
            out += [f"{path}:{n}:{s}" for n, s in rows]
        elif b.total:
            out.append(f"{path}: {head.total if head else 0} lines")
        else:
            out.append(render.window_text(path, b, rows, bool(head is None or head.eof)))
    return out


def main() -> int:
    spark = SparkSession.builder.appName("linequarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print("\n".join(run(spark, sys.argv[1:])))
        return 0
    except QueryError as e:
        print(render.error_sentinel(e))
        return 2


if __name__ == "__main__":
    sys.exit(main())
