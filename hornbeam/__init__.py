"""Graph, rule and retrieval analytics as PySpark plans."""
