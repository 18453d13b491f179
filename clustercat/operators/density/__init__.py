"""Hierarchical density clustering as distributed table operators."""
