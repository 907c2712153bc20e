"""Images of graphs and dendrograms as SVG text."""

from .drawing import svg_dendrogram, svg_graph, visualize_bigraph, visualize_dendrogram, visualize_graph

svg_bigraph = visualize_bigraph
__all__ = ["svg_bigraph", "svg_dendrogram", "svg_graph", "visualize_bigraph", "visualize_dendrogram", "visualize_graph"]
