"""All registered queries: name -> callable(spark, sf_dir), and the DuckDB SQL each must equal."""

from __future__ import annotations

from . import catalogue_queries, kv_queries, language_queries, lookup_queries, measure_queries, retrieval_queries, scoped_queries, sql_queries, stream_queries  # noqa: F401  (they register)
from .base import ORACLES, QUERIES  # noqa: F401
