"""Runnable queries over the test tables."""

from importlib import import_module

MODULES = (
    "race_analytics",
    "inventory_queries",
    "replay_queries",
    "normalize_queries",
    "telemetry_queries",
    "learning_queries",
    "strategy_queries",
    "source_queries",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"lapwing.plans.{name}")
