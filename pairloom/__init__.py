"""A Spark-native engine for relative-value research on price panels."""
