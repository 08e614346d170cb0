"""All queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from intel_spark.llm import centroids, contexttree, covertree, decontaminate, html, jaccard, pieces, prefixtrie, sharding, surrogates, tokencounts, toxicity, warc  # noqa: F401  (they register their queries)
from intel_spark.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
