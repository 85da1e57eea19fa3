"""batchwise: Spark-native incremental text classification and clustering."""
