"""tablepulse: Spark-native health analytics over lake-table metadata."""
