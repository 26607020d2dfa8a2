"""Tools: clustering, polygons, shape metrics."""

from nichespark.operators.autok import ClusterAutoK
from nichespark.operators.batch import TRVAE, standardised_pca
from nichespark.operators.gmm import Cluster, GaussianMixture
from nichespark.operators.shape import boundaries, curl, curl_metric, elongation, elongation_metric, linearity, linearity_metric, purity, purity_metric, relative_component_size_metric

__all__ = ["TRVAE", "Cluster", "ClusterAutoK", "GaussianMixture", "boundaries", "curl", "curl_metric", "elongation", "elongation_metric", "linearity", "linearity_metric", "purity", "purity_metric", "relative_component_size_metric", "standardised_pca"]
