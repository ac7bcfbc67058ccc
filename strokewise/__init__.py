"""Behaviour analytics on Spark DataFrames."""
