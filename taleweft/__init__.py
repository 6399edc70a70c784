"""Spark-native engine for narrative collections: ingest, search, hierarchy, conversation."""
