"""quarry: a Spark-native corpus retrieval, evaluation and data-preparation engine."""
