"""Larkspur: cohort statistics and survival analysis on Spark DataFrames."""
