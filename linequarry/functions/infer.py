"""One regular expression for a whole query, where there is one: for other engines and as a test oracle."""

from __future__ import annotations

import itertools
import re

from .expr import Plan, Predicate, as_plan


def _pattern(p: Predicate) -> str:
    if p.kind == "regex":
        return f"(?:{p.value})"
    text = re.escape(p.value)
    return f"^{text}" if p.kind == "prefix" else f"{text}$" if p.kind == "suffix" else text


def as_regex(query: str | Plan) -> str | None:
    """Alternatives for ``||``; for ``&&`` of two or three, all orders with anything between. None for more.

    Parts joined by ``&&`` must not overlap in a line, which a single pattern cannot express.
    """
    plan = as_plan(query)
    parts = [_pattern(p) for p in plan.predicates]
    if len(parts) == 1:
        return parts[0]
    if plan.mode == "any":
        return "|".join(parts)
    return "|".join(".*".join(order) for order in itertools.permutations(parts)) if len(parts) <= 3 else None
