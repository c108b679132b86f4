"""Library-curation analytics as Spark DataFrame operators."""
