"""Conversation auditing and data preparation on Spark DataFrames."""
