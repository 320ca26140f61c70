"""Registered queries."""

from . import attention, directory, documents, graph, io, serving, text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
