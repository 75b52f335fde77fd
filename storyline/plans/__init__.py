"""Queries bound to the given tables, one per operator, with their SQL twins."""

import importlib

MODULES = (
    "q_text", "q_outlets", "q_feed", "q_mutate", "q_dedup", "q_cluster", "q_digest", "q_sources",
    "q_validate", "q_stream",
)


def load_all() -> None:
    """Import every query module, so that the registry is complete."""
    for name in MODULES:
        importlib.import_module(f"storyline.plans.{name}")
