"""All registered queries of the engine."""

from __future__ import annotations

from lodeweave.plans import models, retrieval, steps, tabular, text  # noqa: F401
from lodeweave.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "bm25_topk"
