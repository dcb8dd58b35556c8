"""The queries of the engine over the driver's tables, and SQL for each."""

from . import stored  # noqa: F401 registers its queries
from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
