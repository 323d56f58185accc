"""The subpackage's queries and their SQL counterparts."""

from . import bpe, decontaminate, extract, lines, mixing, passages, prefixes, quality, resample, secrets, simhash, topk, warc  # noqa: F401
from .common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
