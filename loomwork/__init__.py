"""A Spark-native engine for schemaless documents, keyed collections and vectors."""
