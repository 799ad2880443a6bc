"""Cohort, time-series, connectivity and spike-train analytics on Spark DataFrames."""
