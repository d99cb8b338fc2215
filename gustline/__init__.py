"""Hourly time-series features, forecasts and drift monitoring on Spark."""
