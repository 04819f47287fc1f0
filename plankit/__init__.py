"""A relational and nested-data algebra over Spark DataFrames."""
