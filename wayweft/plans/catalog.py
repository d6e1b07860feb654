"""All registered queries."""

from __future__ import annotations

from wayweft.plans import catalog_diff, catalog_extract, catalog_graph, catalog_text

MODULES = [catalog_graph, catalog_text, catalog_diff, catalog_extract]


def all_queries() -> dict:
    out = {}
    for module in MODULES:
        for name, (run, sql) in module.QUERIES.items():
            assert name not in out, name
            out[name] = (run, sql)
    return out
