"""A Spark-native engine for preparing N-dimensional volumes and training corpora."""
