"""All registered queries."""

from creditspark.workload import (  # noqa: F401
    cleaning_queries, macro_queries, master_queries, model_queries, panel_queries, validation_queries,
)
from creditspark.workload.panel_queries import flagship
from creditspark.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
