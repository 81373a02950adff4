"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

import importlib

#: Modules of queries; each has QUERIES: name -> (function, SQL or None).
MODULES = ["retrieval", "corpus", "graph", "evaluation", "governance", "sessions", "answers", "inference", "metrics", "dedupe"]


def _all():
    out = {}
    for m in MODULES:
        out |= importlib.import_module(f"quarry.plans.{m}").QUERIES
    return out


def flagship(spark, sf_dir):
    return _all()["hybrid_search"][0](spark, sf_dir)


def queries():
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql():
    return {k: s for k, (_, s) in _all().items() if s}
