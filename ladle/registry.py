"""Named queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ladle.queries import embedding, flows, substitution, taxonomies, texts

MODULES = (substitution, texts, taxonomies, embedding, flows)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
