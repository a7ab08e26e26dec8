"""millrace: Spark-native analytics over plant documents, graphs and condition readings."""
