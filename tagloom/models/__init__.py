"""Regression models and experiments on Spark ML."""
