"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import (corpus_queries, eval_queries, feature_queries, io_queries, ml_queries, nb_queries,  # noqa: F401
               relational_queries, text_queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
