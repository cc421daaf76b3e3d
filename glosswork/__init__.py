"""Glosswork: annotation, symbol and document analytics on Spark DataFrames."""
