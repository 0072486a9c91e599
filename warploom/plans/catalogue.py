"""All queries of the engine by name, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from ..session import sound

MODULES: list[str] = ["advantage_plans", "frame_plans", "corpus_plans", "search_plans", "eval_plans", "credit_plans", "nav_plans"]


def queries() -> dict[str, Callable]:
    return {k: sound(v) for m in MODULES for k, v in import_module(f"warploom.plans.{m}").queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"warploom.plans.{m}").oracle_sql().items()}
