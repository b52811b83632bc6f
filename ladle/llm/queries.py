"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["bpe", "langid", "quality", "toxicity", "urlfilter", "merkle", "neardup", "repeats", "decontaminate", "licenses", "phrases", "secretscan", "whitening"]


def _modules() -> list:
    return [importlib.import_module(f"{__package__}.{name}") for name in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All functions op<N>_<name>."""
    return {k: f for m in _modules() for k, f in vars(m).items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    """OP<N>_SQL of a module belongs to its op<N>_<name>."""
    found = {}
    for m in _modules():
        for k, f in vars(m).items():
            if k.startswith("op") and k[2:3].isdigit() and (sql := vars(m).get(f"{k.split('_')[0].upper()}_SQL")):
                found[k] = sql
    return found
