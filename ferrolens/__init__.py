"""A Spark-native engine for equipment analytics and document retrieval."""
