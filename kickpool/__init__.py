"""Football-pool analytics as PySpark DataFrame operators."""
