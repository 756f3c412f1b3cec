"""Data-quality, reconciliation, split, vector and ranking-metric queries as Spark DataFrame operators."""
