"""Settings of an analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    threshold: float = 0.88
    top_n: int = 10
    edge_scope: str = "question"  # or unit
    budget_hours: float = 12.0
    value: str = "frequency"  # or marks
    default_hours: float = 2.0
    hours_override: dict[str, float] = field(default_factory=dict)
