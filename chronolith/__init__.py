"""A time-series query engine on DataFrames."""
