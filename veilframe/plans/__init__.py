"""Registered queries and their SQL counterparts."""

from . import budgets, privacy, requests, risks, storage, transforms  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
