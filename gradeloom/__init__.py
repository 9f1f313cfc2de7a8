"""Cohort review analytics and training-data preparation on Spark DataFrames."""
