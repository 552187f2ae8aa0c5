"""Every query of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from shopweave.sources.shop import Shop

MODULES = ("sales", "inventory", "ledger", "ingest", "series", "hierarchy", "forecast", "stream")


def _all() -> dict:
    out = {}
    for name in MODULES:
        own = import_module(f"shopweave.plans.{name}").QUERIES
        if clash := out.keys() & own.keys():
            raise ValueError(f"two queries have one name: {sorted(clash)}")
        out |= own
    return out


def _on_shop(run):
    return lambda spark, sf_dir: run(Shop(spark, sf_dir))


def queries() -> dict:
    return {name: _on_shop(run) for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: text for name, (_, text) in _all().items() if text}
