"""rillwave: composable, count-based windowed signals on Spark DataFrames."""

from rillwave.plans.features import features, final

__all__ = ["features", "final"]
__version__ = "0.1.0"
