"""Document-corpus analytics as Spark DataFrame operators."""
