"""All queries over the driver's tables, with their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("text", "votes", "refs", "values", "dates", "trees", "pages", "names", "sources", "streams", "catalogue", "layouts", "references", "spans", "cleaning", "extraction")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, (f, _) in importlib.import_module(f"marginalia.plans.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in importlib.import_module(f"marginalia.plans.{m}").QUERIES.items() if sql}
