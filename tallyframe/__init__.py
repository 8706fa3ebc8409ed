"""Data reconciliation and data-quality testing on Spark DataFrames."""
