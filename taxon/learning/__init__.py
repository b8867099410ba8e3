"""Fitting, tuning and applying classifiers on Spark ML."""
