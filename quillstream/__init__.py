"""A PySpark-native analytics engine for cited-document corpora and time-coded media metadata."""
