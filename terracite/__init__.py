"""Terracite: document, graph and retrieval analytics as Spark DataFrame jobs."""
