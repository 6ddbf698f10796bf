"""foliospark: a PySpark-native engine for document-page corpora."""
