"""Vendor-portfolio analytics on Spark DataFrames."""
