"""Faultline: evidence linking and root-cause analytics on Spark DataFrames."""
