"""Spark-native entity resolution: block, compare, select, cluster, fold, measure."""

__version__ = "0.1.0"
