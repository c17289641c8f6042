"""Default-probability models on pyspark.ml."""
