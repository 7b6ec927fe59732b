"""Registered queries. ``load`` imports every module that registers some."""

from importlib import import_module

MODULES = ["staging", "profile", "marts", "verticals", "content", "ingest", "controls", "reads", "primitives"]


def load():
    from tenantlens.registry import core

    for name in MODULES:
        import_module(f"tenantlens.registry.{name}")
    return core.QUERIES, core.ORACLES
