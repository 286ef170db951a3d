"""A Spark-native engine for families of near-identical sequences."""
