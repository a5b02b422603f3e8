"""All queries of the library outside ``llm``, with their DuckDB statements."""

from __future__ import annotations

from rulewright.plans import answerability, conversations, corpus, datapoints, detection, geometry, images, masks, mining, mixtures, packages, records, rows, scores, spans, splits, stages, streams, texts, tracks  # noqa: F401
from rulewright.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
