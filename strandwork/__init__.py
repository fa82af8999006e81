"""PySpark-native retrieval, ranking and compression of document collections."""
