"""Chronolith: bitemporal document analytics and ranked retrieval on Spark DataFrames."""
