"""The rule for one load or unload, for code that runs on rows inside a task."""

from __future__ import annotations

LOAD, UNLOAD = 1, -1


def advance(loaded: list, ever: list, budget: int, op: int, skill: str) -> str:
    """Apply one valid action to the two lists in place and name the outcome."""
    present = skill in loaded
    if op == UNLOAD:
        if not present:
            return "not_loaded"
        loaded.remove(skill)
        return "unloaded"
    if present:
        return "already_loaded"
    if len(loaded) >= budget:
        return "budget_full"
    loaded.append(skill)
    if skill not in ever:
        ever.append(skill)
    return "loaded"
