"""Queries that bind the operators to tables; importing this package fills the registry."""

from subsida.plans import queries_functions, queries_joins, queries_models, queries_more, queries_series, queries_stm  # noqa: F401
