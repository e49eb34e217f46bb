"""Larkspar: code similarity, call graphs and training-data operators on Spark DataFrames."""
