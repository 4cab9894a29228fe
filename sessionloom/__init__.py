"""Conversation analytics and corpus processing on Spark DataFrames."""
