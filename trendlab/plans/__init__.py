from trendlab.plans.jobs import (
    Outputs, build_mapping, build_trend_matrix, embed_kept_terms, export_mapping, run_pipeline, verify_stored,
)

__all__ = [
    "Outputs", "build_mapping", "build_trend_matrix", "embed_kept_terms", "export_mapping", "run_pipeline",
    "verify_stored",
]
