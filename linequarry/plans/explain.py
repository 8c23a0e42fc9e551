"""What a query means and which evidence it allows, as JSON; no data is read."""

from __future__ import annotations

import json

from ..functions.evidence import proof_program
from ..functions.expr import Plan, as_plan


def explain(query: str | Plan) -> dict:
    plan = as_plan(query)
    proof = proof_program(plan)
    terms = [(t.decode("latin-1"), index) for t, index in proof.terms]
    return {
        "source": plan.source, "mode": plan.mode,
        "predicates": [{"type": p.kind, "value": p.value, "strategy": p.strategy} for p in plan.predicates],
        "proof_program": {
            "query_class": proof.query_class, "mandatory_evidence": [t for t, _ in terms],
            "posting_plan": [{"key": t, "source_index": i, "cardinality": None, "repr": "unknown"} for t, i in terms],
            "candidate_files_before": None, "candidate_files_after": None, "verifier": proof.verifier, "fallback": proof.fallback,
        },
    }


def explain_json(query: str | Plan) -> str:
    return json.dumps(explain(query), ensure_ascii=False)
