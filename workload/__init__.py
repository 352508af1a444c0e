"""Queries over the given tables, each with the SQL it is checked against."""

from importlib import import_module

MODULES = ["analysis", "cleaning", "profiling", "relational", "verification", "findings", "sources", "plans"]


def load_all():
    """(queries, oracle SQL) of every module, by name."""
    for m in MODULES:
        import_module(f"workload.{m}")
    from workload.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
