"""Forecasting models as plans: a model is its partition and its rules, both tables."""
