"""Metrics, reports and panels: DataFrame in, DataFrame out."""
