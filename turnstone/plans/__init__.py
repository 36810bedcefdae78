"""Query catalogues."""

import importlib

MODULES = ("catalog_access", "catalog_documents", "catalog_layout", "catalog_review", "catalog_streaming")


def load_catalog():
    for name in MODULES:
        importlib.import_module(f"turnstone.plans.{name}")
    return importlib.import_module("turnstone.catalog")
