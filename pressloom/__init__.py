"""pressloom: a Spark-native engine for news ingestion and analytics."""
