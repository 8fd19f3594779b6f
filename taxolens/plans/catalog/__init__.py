"""Query catalog: every registered operator query with its DuckDB oracle SQL.

Importing this package imports each group module, which registers its
queries into ``REGISTRY`` (name → (callable(spark, sf_dir), sql | None)).
"""

from taxolens.plans.catalog.registry import REGISTRY, oracle_sql, queries  # noqa: F401
from taxolens.plans.catalog import (  # noqa: F401  (registration side effects)
    q_text,
    q_metrics,
    q_reports,
    q_vectors,
    q_cluster,
    q_flows,
    q_ensemble,
    q_models,
    q_run,
)
