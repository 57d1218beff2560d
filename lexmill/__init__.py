"""lexmill: a Spark-native engine for ordered document text and versioned provisions."""
