"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from .plans import controls, evaluation, experiments, preparation, relational, search, service

_PARTS = (preparation, evaluation, search, relational, experiments, controls, service)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
