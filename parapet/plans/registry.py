"""All registered queries and their SQL."""

from parapet.plans import arrivals, audit, records, requests, screening  # noqa: F401  (registers their queries)
from parapet.plans.common import REGISTRY


def queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
