"""A PySpark-native question-answering analytics engine for business data."""
