"""What a matching document must contain: needles, trigrams, and the proof program made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .expr import Plan, Predicate
from .strategy import branches, longest_fragment, mandatory_prefix, plain_literal, split_fold, word_literal

MAX_TRIGRAMS = 64


def needle(p: Predicate) -> str:
    """A text that every matching line holds, '' if none of two bytes or more is known."""
    if p.kind != "regex":
        got = p.value
    else:
        fold, body = split_fold(p.value)
        got = "" if fold else plain_literal(body) or word_literal(body) or longest_fragment(p.value)
    return got if len(got.encode()) >= 2 else ""


def trigrams(p: Predicate) -> tuple[bytes, ...]:
    if p.kind != "regex":
        text = p.value
    else:
        fold, body = split_fold(p.value)
        text = "" if fold or len(branches(body)) > 1 else word_literal(body) or mandatory_prefix(p.value)
    raw = text.encode()
    return tuple(dict.fromkeys(raw[i : i + 3] for i in range(len(raw) - 2)))[:MAX_TRIGRAMS]


@dataclass(frozen=True)
class Admission:
    mode: str
    groups: tuple[tuple[int, tuple[bytes, ...]], ...]  # (predicate index, its trigrams)
    ignored: int
    reason: str  # none, no_mandatory_trigram, disjunction_has_unindexed_branch

    @property
    def eligible(self) -> bool:
        return bool(self.groups)


def admit(plan: Plan) -> Admission:
    groups, ignored = [], 0
    for index, p in enumerate(plan.predicates):
        got = trigrams(p)
        if got:
            groups.append((index, got))
            continue
        ignored += 1
        if plan.mode == "any":
            return Admission("any", (), ignored, "disjunction_has_unindexed_branch")
    return Admission(plan.mode, tuple(groups), ignored, "none" if groups else "no_mandatory_trigram")


@dataclass(frozen=True)
class Proof:
    query_class: str
    verifier: str
    fallback: str | None
    terms: tuple[tuple[bytes, int], ...] = field(default=())


def proof_program(plan: Plan) -> Proof:
    a = admit(plan)
    regex = any(p.kind == "regex" for p in plan.predicates)
    window = any(p.strategy == "regex_full" or p.decomposed for p in plan.predicates)
    verifier = "regex_window" if window else "line_exact"
    if not a.eligible:
        return Proof("verifier_only", verifier, "no_mandatory_evidence" if a.reason == "no_mandatory_trigram" else a.reason)
    kind = "disjunctive_byte_evidence" if plan.mode == "any" else "conjunctive_regex_with_mandatory_evidence" if regex else "conjunctive_literal_evidence"
    return Proof(kind, verifier, None, tuple((t, index) for index, group in a.groups for t in group))
