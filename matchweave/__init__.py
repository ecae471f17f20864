"""Contest-history and forecast analytics as PySpark DataFrame operators."""
