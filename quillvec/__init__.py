"""Versioned vector search and corpus preparation on PySpark."""
