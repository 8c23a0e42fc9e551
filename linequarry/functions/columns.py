"""Predicates and plans as Spark columns.

Tests on whole texts stay on UTF-8 strings (a substring of valid UTF-8 matches
exactly where its bytes do); positions and regular expressions work on the
byte view, where a character is a byte, so columns are byte columns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .evidence import admit, needle
from .expr import Plan, Predicate, as_plan
from .regex import NeedsFallback, byte_view, to_java
from .strategy import alternates, plain_literal, split_fold, word_literal

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def bytes_of(text: Column) -> Column:
    """One character per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _fallback(pattern: str, fold: bool, what: str):
    """Regular expressions that Java lacks, by the Python engine over Arrow batches of byte views."""
    source, flags = byte_view(pattern), fold

    @F.pandas_udf("int")
    def run(lines: pd.Series) -> pd.Series:
        import regex

        rx = regex.compile(source, (regex.I if flags else 0) | regex.A | regex.V0)
        if what == "count":
            return lines.map(lambda s: None if s is None else sum(1 for _ in rx.finditer(s))).astype("Int32")
        return lines.map(lambda s: None if s is None else m.start() + 1 if (m := rx.search(s)) else 0).astype("Int32")

    return run


class Matcher:
    """Columns of one predicate on a line (``\\r`` already trimmed)."""

    def __init__(self, p: Predicate, fold: bool = False, raw: bool = False):
        """raw: the text already is a byte view."""
        self.p, self.fold, self.raw = p, fold, raw
        self.view = (lambda c: c) if raw else bytes_of
        inline, body = split_fold(p.value) if p.kind == "regex" else (False, p.value)
        self.fold_literal = fold or inline
        self.literals: list[str] | None = None
        self.java = self.python = None
        if p.kind != "regex":
            self.literals = [p.value]
        elif (plain := plain_literal(body)) is not None:
            self.literals = [plain]
        elif word_literal(body) is None and not inline and (alts := alternates(body)):
            self.literals = alts
        else:
            try:
                self.java = ("(?i)" if fold and not inline else "") + to_java(p.value)
            except NeedsFallback:
                self.python = p.value
        if raw and self.literals is not None:
            self.literals = [byte_view(v) for v in self.literals]

    def _both(self, line: Column, value: str) -> tuple[Column, str]:
        return (ascii_lower(line), value.translate(_FOLD)) if self.fold_literal else (line, value)

    def test(self, line: Column) -> Column:
        if self.literals is not None:
            out = None
            for value in self.literals:
                x, v = self._both(line, value)
                hit = x.startswith(v) if self.p.kind == "prefix" else x.endswith(v) if self.p.kind == "suffix" else F.contains(x, F.lit(v))
                out = hit if out is None else out | hit
            return out
        if self.python:
            return (line != "") & (_fallback(self.python, self.fold, "find")(self.view(line)) > 0)
        hit = (line != "") & F.rlike(self.view(line), F.lit(self.java))
        must = "" if self.fold_literal else needle(self.p)
        must = byte_view(must) if self.raw else must
        return F.contains(line, F.lit(must)) & hit if must else hit

    def column(self, line: Column) -> Column:
        """1-based byte column of the first match, 0 if there is none."""
        if self.p.kind == "prefix":
            return F.when(self.test(line), 1).otherwise(0)
        if self.p.kind == "suffix":
            return F.when(self.test(line), (F.length(line) if self.raw else F.octet_length(line)) - len(self.p.value.encode()) + 1).otherwise(0)
        if self.literals is not None:
            spots = []
            for value in self.literals:
                x, v = self._both(line, value)
                spots.append(F.nullif(F.instr(self.view(x), v if self.raw else byte_view(v)), F.lit(0)))
            return F.coalesce(F.least(*spots) if len(spots) > 1 else spots[0], F.lit(0))
        if self.python:
            return F.when(line != "", _fallback(self.python, self.fold, "find")(self.view(line))).otherwise(0)
        return F.when(line != "", F.regexp_instr(self.view(line), F.lit(self.java))).otherwise(0)

    def count(self, text: Column) -> Column:
        """Occurrences (one literal, full regular expressions) or 1 per matching line (the others)."""
        s = self.p.strategy
        if s in ("literal", "regex_plain_literal", "regex_ascii_casefold_literal"):
            x, v = self._both(text, self.literals[0])
            return ((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(v), F.lit("")))) / len(v.encode())).cast("long")
        if s in ("regex_full", "regex_fixed_width_bytes") and not self.p.decomposed:
            if self.python:
                return F.when(text != "", _fallback(self.python, self.fold, "count")(self.view(text))).otherwise(0).cast("long")
            return F.when(text != "", F.regexp_count(self.view(text), F.lit(self.java))).otherwise(0).cast("long")
        return self.test(text).cast("long")


def matchers(query: str | Plan, fold: bool = False, raw: bool = False) -> list[Matcher]:
    return [Matcher(p, fold, raw) for p in as_plan(query).predicates]


def line_test(query: str | Plan, line: Column, fold: bool = False, raw: bool = False) -> Column:
    plan, out = as_plan(query), None
    for m in matchers(plan, fold, raw):
        t = m.test(line)
        out = t if out is None else (out & t if plan.mode == "all" else out | t)
    return out


def line_column(query: str | Plan, line: Column, fold: bool = False, raw: bool = False) -> Column:
    """Least column of the matching predicates, 0 if the line does not match."""
    plan = as_plan(query)
    spots = [m.column(line) for m in matchers(plan, fold, raw)]
    if len(spots) == 1:
        return spots[0]
    least = F.least(*[F.nullif(s, F.lit(0)) for s in spots])
    if plan.mode == "any":
        return F.coalesce(least, F.lit(0))
    every = spots[0] > 0
    for s in spots[1:]:
        every = every & (s > 0)
    return F.when(every, least).otherwise(0)


def line_count(query: str | Plan, line: Column, fold: bool = False, raw: bool = False) -> Column:
    plan = as_plan(query)
    if len(plan.predicates) == 1:
        return matchers(plan, fold, raw)[0].count(line)
    return line_test(plan, line, fold, raw).cast("long")


def needs_python(query: str | Plan) -> bool:
    """Whether a predicate runs in Python; such tests cannot stand inside a lambda over an array."""
    return any(m.python for m in matchers(query))


def counts_whole_text(query: str | Plan) -> bool:
    """Whether occurrences may be counted on a text without splitting it: one literal free of line ends."""
    plan = as_plan(query)
    if len(plan.predicates) != 1 or not plan.predicates[0].literal_counter:
        return False
    return not re.search(r"[\r\n]", matchers(plan)[0].literals[0])


def may_match(query: str | Plan, text: Column, fold: bool = False, trigrams: bool = True, raw: bool = False) -> Column | None:
    """A test on whole texts that every matching one passes; None if nothing is known."""
    plan = as_plan(query)
    if fold:
        return None
    musts = [byte_view(needle(p)) if raw else needle(p) for p in plan.predicates]
    if plan.mode == "any":
        if "" in musts:
            return None
        out = None
        for m in dict.fromkeys(musts):
            t = F.contains(text, F.lit(m))
            out = t if out is None else out | t
        return out
    tests = [F.contains(text, F.lit(m)) for m in dict.fromkeys(musts) if m]
    covered = {i for i, m in enumerate(musts) if m}
    if trigrams:
        tests += [t for i, group in admit(plan).groups if i not in covered for t in _has_all(text, group, raw)]
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def _has_all(text: Column, group, raw: bool) -> list[Column]:
    view = text if raw else bytes_of(text)
    return [F.contains(view, F.lit(t.decode("latin-1"))) for t in group]


def trigram_test(query: str | Plan, text: Column, raw: bool = False) -> Column | None:
    """Trigram admission alone: all trigrams of all groups, or of any group for ``||``."""
    a = admit(as_plan(query))
    if not a.eligible:
        return None
    out = None
    for _, group in a.groups:
        all_ = None
        for t in _has_all(text, group, raw):
            all_ = t if all_ is None else all_ & t
        out = all_ if out is None else (out & all_ if a.mode == "all" else out | all_)
    return out
