"""lodeweave: a Spark-native engine for document retrieval and tabular analytics."""
