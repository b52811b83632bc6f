"""Queries by key; importing a module registers its queries."""

import importlib

from ladle.plans import registry

MODULES = ["basics", "relational", "texts", "composites", "recommending"]


def load():
    for name in MODULES:
        importlib.import_module(f"ladle.plans.{name}")
    return registry
