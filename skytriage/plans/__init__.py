"""Named queries over the shared tables."""

import importlib

_FAMILIES = ("geometry", "scoring", "motion", "dataset", "labelled", "triage", "tracking", "source", "table")


def load_all() -> None:
    """Import every query family; importing registers its queries."""
    for name in _FAMILIES:
        importlib.import_module(f"skytriage.plans.{name}_queries")
