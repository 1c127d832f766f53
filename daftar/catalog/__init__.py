"""Every registered query; importing this package fills the registry."""

from daftar.catalog import evaluation_queries, operations_queries, retrieval_queries, text_queries  # noqa: F401
from daftar.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
