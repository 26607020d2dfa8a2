"""Tables behind figures."""

from nichespark.plans.figures import autok_stability, boundaries, diff_nhood_enrichment, enrichment, nhood_enrichment, plot_boundaries, plot_shape_metrics, plot_shapes, proportion, shape_metrics

__all__ = ["autok_stability", "boundaries", "diff_nhood_enrichment", "enrichment", "nhood_enrichment", "plot_boundaries", "plot_shape_metrics", "plot_shapes", "proportion", "shape_metrics"]
