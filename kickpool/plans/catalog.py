"""All registered queries. Importing a module registers what it defines."""

from kickpool.plans import (
    backtest_queries,
    import_queries,
    page_queries,
    prediction_queries,
    storage_queries,
    table_queries,
)
from kickpool.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "backtest_queries",
    "import_queries",
    "page_queries",
    "prediction_queries",
    "storage_queries",
    "table_queries",
]
