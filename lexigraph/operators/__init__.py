"""Operators: DataFrame to DataFrame, over whole tables of documents and of queries."""
