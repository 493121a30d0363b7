"""quire: document analytics as Spark DataFrame operators."""
