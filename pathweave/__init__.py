"""Property-graph retrieval and document analytics as PySpark DataFrame operators."""
