"""Fuzzy time-series analytics and data processing on Spark: rules, sets, forecasts and results are DataFrames."""
