"""Spark-first analytics: declarative plans over DataFrames, left to Catalyst and AQE to schedule."""
