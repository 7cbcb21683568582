"""Spark-native document retrieval and knowledge-graph analytics."""
