"""Catalog, profiling and ingestion operators for data sources, on Spark.

Every operator is a function from DataFrame to DataFrame; see the README for
the map of modules.
"""
