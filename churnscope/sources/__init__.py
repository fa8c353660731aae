from churnscope.sources.adapters import ADAPTERS, from_events, from_orders, load
from churnscope.sources.results import (
    load_model, read_results, save_model, write_results,
)
from churnscope.sources.transactions import RAW_SCHEMA, read_transactions

__all__ = [
    "ADAPTERS", "RAW_SCHEMA", "from_events", "from_orders", "load", "load_model",
    "read_results", "read_transactions", "save_model", "write_results",
]
