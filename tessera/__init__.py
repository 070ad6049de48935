"""A text search and analytics engine on Spark DataFrames."""
