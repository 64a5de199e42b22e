"""Spatial statistics over Spark DataFrames, and operators for training data in ``llm``."""
