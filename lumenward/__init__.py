"""A Spark-native engine that scans text for content aimed at automated readers."""
