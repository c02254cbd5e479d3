"""A PySpark-native analytics library: DataFrame queries over parquet tables."""
