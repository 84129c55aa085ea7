"""Presence cases: task queries whose packets must hold given strings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from lodestrand.plans.engine import Engine


@dataclass(frozen=True)
class Case:
    task: str
    must_have: tuple[str, ...]


@dataclass(frozen=True)
class Outcome:
    task: str
    missing: str | None  # the first string that the packet lacks
    size: int  # of the packet, in bytes


#: Seven cases on the source tree of this package.
OWN = (
    Case("where is the status route of the service handled", ("service.py",)),
    Case("how are unresolved edges resolved by name", ("resolve.py", "best_candidate")),
    Case("how is context retrieved for a task query", ("retrieve.py",)),
    Case("how is a compact packet rendered and expanded", ("render.py", "expand:")),
    Case("where are generations of the graph stored", ("store.py", "GraphStore")),
    Case("how does the extractor find python symbols", ("extract.py", "extract_python")),
    Case("how do the force steps place projected nodes", ("project.py", "force_steps")),
)


def run(engine: Engine, cases: Iterable[Case] = OWN) -> list[Outcome]:
    """Each task as a query; strings are looked for in order, and the first that is missing fails the case."""
    out = []
    for case in cases:
        packet = engine.retrieve("task", case.task)
        out.append(Outcome(case.task, next((s for s in case.must_have if s not in packet), None), len(packet.encode())))
    return out


def report(outcomes: list[Outcome]) -> str:
    lines = [f"=== retrieval cases ({len(outcomes)}) ==="]
    for o in outcomes:
        lines.append(f'  [PASS] "{o.task}" (~{o.size} bytes)' if o.missing is None else f'  [FAIL] "{o.task}"\n         missing: {o.missing}')
    passed = sum(o.missing is None for o in outcomes)
    return "\n".join([*lines, f"=== {passed}/{len(outcomes)} passed ===", ""])
