"""sluice: configuration-driven data-quality checks and loads on Spark DataFrames.

Every row-level rule is a Column expression, so validation, normalisation,
deduplication and loading run as ordinary Catalyst plans (whole-stage codegen,
partial aggregation, AQE) instead of per-row driver code.
"""

from sluice.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
