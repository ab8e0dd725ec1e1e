"""Relational feature engineering and scoring on Spark DataFrames."""
