"""Graph operators."""

from nichespark.operators.build import delaunay_edges, knn_edges, lattice_edges, radius_edges
from nichespark.operators.components import connected_components
from nichespark.operators.group import enrichment
from nichespark.operators.khop import aggregate_neighbors
from nichespark.operators.nhood import diff_nhood_enrichment, nhood_enrichment
from nichespark.operators.prune import remove_intra_cluster_links, remove_long_links

__all__ = ["aggregate_neighbors", "connected_components", "delaunay_edges", "diff_nhood_enrichment", "enrichment", "knn_edges", "lattice_edges", "nhood_enrichment", "radius_edges", "remove_intra_cluster_links", "remove_long_links"]
