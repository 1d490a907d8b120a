"""Registered queries: importing this package fills the registry."""

from . import alignment, audits, evaluation, forms, retrieval, reviews, tables, text  # noqa: F401
