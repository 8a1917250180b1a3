"""Portfolio, compliance and dashboard analytics as PySpark DataFrame operators."""
