"""All registered queries; importing a module registers its queries."""

from tidemark.plans import agg_queries, base_queries, event_queries, feature_queries, fold_queries, inference_queries, join_queries, machine_queries, model_queries, scale_queries, source_queries, stream_queries, variant_queries, window_queries  # noqa: F401
from tidemark.plans.registry import COVERS, ORACLE, QUERIES  # noqa: F401
