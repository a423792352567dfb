"""Gridloom: a Spark-native engine for exploring, editing and saving Parquet data."""
