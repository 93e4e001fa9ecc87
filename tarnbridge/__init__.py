"""A PySpark-native retrieval, evaluation and corpus-preparation engine."""
