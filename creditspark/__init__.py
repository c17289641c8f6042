"""Loan-level credit-risk analytics on Spark DataFrames."""
