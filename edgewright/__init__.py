"""Causal reasoning over prior-knowledge graphs, as Spark DataFrame plans."""
