"""From a pixel-by-feature table to spatial components: tiles, neighbour graph, components, tests, groups of features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spectrel.operators import blocks, features, graph
from spectrel.plans import clustering
from spectrel.plans.spaco import Spaco, significant
from spectrel.runtime import settled


class Analysis:
    """``coo``: x, y, feature, value. The features are few enough to be columns; tiles and edges stay distributed.

    Edges go from each tile to its ``k`` nearest, itself among them, weighted by distance, or both ways with weight 1 if ``binary``.
    """

    def __init__(self, coo: DataFrame, grid_size: int = 40_000, how: str = "median", k: int = 30, binary: bool = False, keep: float = 0.95, cut: float | None = None):
        tiles = settled(features.tile_aggregate(coo, grid_size, how))
        self.labels = [r[0] for r in tiles.select("feature").distinct().orderBy("feature").collect()]
        self.rows = settled(features.to_vectors(tiles, self.labels))
        edges = graph.knn(self.rows.select("id", "x", "y"), k)
        self.spaco = Spaco(self.rows.select("id", "x", "y", "v"), graph.symmetric(edges) if binary else edges, keep, cut, blocks.interleaved("x", "y"))

    def tests(self) -> DataFrame:
        """feature (its place in ``labels``), stat, cdf, p_value of the raw columns."""
        return self.spaco.test(self.rows.select("id", "v"))

    def significant(self, level: float = 0.05) -> DataFrame:
        return significant(self.tests(), level)

    def groups(self, method: str = "kmeans", **options) -> DataFrame:
        """id (the feature's place), label: groups of the features' components, as ``clustering.groups`` makes them."""
        return clustering.groups(clustering.feature_components(self.spaco), method, **options)

    def communities(self, neighbours: int = 10, resolution: float = 1.0) -> DataFrame:
        return self.groups("communities", neighbours=neighbours, resolution=resolution)
