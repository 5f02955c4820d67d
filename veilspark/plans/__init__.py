"""Registered queries: one per operator, most with SQL for an independent check."""

from importlib import import_module

MODULES = (
    "detection", "audit", "scanning", "masking", "pseudonymization", "guarding", "configuration", "scalars", "filing", "streams",
)


def registry():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.kit").REGISTRY
