"""Graph, statistics, clustering and shape operators."""
