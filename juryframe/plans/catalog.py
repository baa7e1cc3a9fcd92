"""Imports every query module, so that importing this one fills the registry."""

from juryframe.plans import journal_queries, review_queries, row_queries, score_queries, shape_queries, span_queries, unit_queries  # noqa: F401
