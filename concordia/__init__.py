"""Analytics of paired measurements as PySpark DataFrame operators."""
