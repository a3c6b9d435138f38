"""Keyed folding, graph and sequence analytics as Spark DataFrame plans."""
