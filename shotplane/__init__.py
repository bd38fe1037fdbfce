"""Burst selection over ordered, measured media, on Spark DataFrames."""
