"""Siftwell: retrieval, grounding and corpus analytics as PySpark DataFrame operators."""
