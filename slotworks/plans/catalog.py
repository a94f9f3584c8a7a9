"""All registered queries."""
from . import (bank_queries, check_queries, evaluation_queries, geometry_queries, label_queries, receipt_queries,  # noqa: F401
               selection_queries, sources_queries)
from .registry import ORACLES, QUERIES  # noqa: F401
