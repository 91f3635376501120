"""Medallion analytics on Spark DataFrames: bronze, silver, gold and quality checks."""
