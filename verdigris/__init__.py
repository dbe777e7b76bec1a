"""verdigris: Spark-native analytics over upgrade-knowledge tables."""
