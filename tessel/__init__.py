"""A Spark-native engine for comparing, classifying and searching structured documents."""
