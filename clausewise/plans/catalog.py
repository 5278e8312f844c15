"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("q_metrics", "q_assess", "q_classify", "q_corpora", "q_structure", "q_retrieval",
            "q_gates", "q_streams", "q_sources")


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"clausewise.plans.{name}"), attr))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
