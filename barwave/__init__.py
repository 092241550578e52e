"""barwave - price-series analytics as Spark DataFrame operators."""
