"""Graph, text, vector, temporal and hybrid retrieval operators and mutations."""
