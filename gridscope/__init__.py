"""gridscope: profile, check and summarise any table with Spark.

Column typing, data quality, outlier-resistant summaries, trends, breakdowns,
histograms, proportions, correlations, filtered re-computation and a small
structured query spec, all expressed as DataFrame operations.
"""

from gridscope.errors import TableError

__all__ = ["TableError"]
