"""Document retrieval and analytics as Spark DataFrame operators."""
