"""A Spark-native engine for document retrieval and learning analytics."""
