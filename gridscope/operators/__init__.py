"""Operators over DataFrames: quantiles, profile, quality, charts, filters, samples."""
