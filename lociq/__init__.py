"""Spark-native interval, sequence and lineage analytics."""
