"""Registered queries, and the join and window plans they share."""

from importlib import import_module

MODULES = ["episode_queries", "catalog_queries", "generator_queries", "grading_queries", "domain_queries", "event_queries", "stream_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"episodica.plans.{name}")
