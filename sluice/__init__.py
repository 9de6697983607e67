"""A Spark-native engine for analysing document flows."""
