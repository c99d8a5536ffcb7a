"""All queries, by importing the modules that register them."""

from __future__ import annotations

from ferrolens.plans import alarms, answers, boards, documents, files, knowledge, life, live, logs, models, retrieval, segments, series, tables, text  # noqa: F401
from ferrolens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
