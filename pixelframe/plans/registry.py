"""All queries of the reference's own operators."""

from . import catalog_queries, derivative_queries, extra_queries, image_queries, match_queries, model_queries, stream_queries  # noqa: F401
from .core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
