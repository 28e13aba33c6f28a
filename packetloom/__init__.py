"""Network-detection analytics as Spark DataFrame operators."""
