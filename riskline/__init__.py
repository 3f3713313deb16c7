"""Cohort, panel, weighting and competing-risk analytics on Spark DataFrames."""
