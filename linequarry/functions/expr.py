"""The line-query language.

A query is one or more predicates joined by ``&&`` or by ``||``.  If ``||``
occurs anywhere it alone separates predicates, and ``&&`` belongs to their
values.  A predicate is ``re:``, ``prefix:``, ``suffix:`` or ``lit:`` followed
by its value; without a tag it is a literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryError
from .strategy import DECOMPOSED, classify, is_decomposed

MAX_PREDICATES = 32
BLANK = " \t\r\n"


@dataclass(frozen=True)
class Predicate:
    kind: str  # literal, regex, prefix, suffix
    value: str

    @property
    def strategy(self) -> str:
        return classify(self.value) if self.kind == "regex" else self.kind

    @property
    def decomposed(self) -> bool:
        return self.kind == "regex" and is_decomposed(self.value)

    @property
    def byte_mode(self) -> bool:
        return True

    @property
    def parallel_count(self) -> bool:
        """Whether shards can be counted apart: all but alternates and decomposed patterns."""
        return self.strategy not in ("regex_literal_alternates", DECOMPOSED)

    @property
    def literal_counter(self) -> bool:
        return self.strategy in ("literal", "regex_plain_literal", "regex_ascii_casefold_literal")

    @property
    def overlap(self) -> int:
        """Bytes that neighbouring ranges must share so that no occurrence is cut."""
        return max(0, len(self.value.encode()) - 1) if self.strategy in ("literal", "regex_plain_literal") else len(self.value.encode())


@dataclass(frozen=True)
class Plan:
    source: str
    mode: str  # all, any
    predicates: tuple[Predicate, ...]


def parse(source: str) -> Plan:
    text = source.strip(BLANK)
    if not text:
        raise QueryError("empty_expression", "the query is empty")
    mode, mark = ("any", "||") if "||" in text else ("all", "&&")
    parts = [p for p in (s.strip(BLANK) for s in text.split(mark)) if p]
    if not parts:
        raise QueryError("empty_predicate", "the query has no predicate")
    if len(parts) > MAX_PREDICATES:
        raise QueryError("too_many_predicates", f"a query has at most {MAX_PREDICATES} predicates")
    return Plan(text, mode, tuple(map(parse_predicate, parts)))


def parse_predicate(text: str) -> Predicate:
    for tag, kind in (("re:", "regex"), ("prefix:", "prefix"), ("suffix:", "suffix"), ("lit:", "literal")):
        if text.startswith(tag):
            value = text[len(tag) :]
            break
    else:
        kind, value = "literal", text
    if not value and kind != "regex":
        raise QueryError(f"empty_{kind}", f"a {kind} predicate needs a value")
    return Predicate(kind, value)


def as_plan(query: str | Plan) -> Plan:
    return query if isinstance(query, Plan) else parse(query)
