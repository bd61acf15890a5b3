"""Operators on method, graph, unit and cluster tables."""
