"""Groups of features: their components, k-means, communities, and maps of groups."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrel.operators import blocks, graph
from spectrel.plans.communities import communities
from spectrel.plans.layout import planar_layout  # noqa: F401
from spectrel.plans.spaco import Spaco
from spectrel.runtime import settled


def feature_components(s: Spaco) -> DataFrame:
    """id, v: a row per tested feature, its form X' L V with the component scores; each component over its norm (0 stays)."""
    both = s.packed.select("block", "n", "m").join(s.white_packed.select("block", "lm"), "block")
    c = blocks.summed(both, ["m", "lm"], lambda a, b: a.T @ b) @ s.loadings
    norm = np.sqrt((c**2).sum(axis=0))
    c = c / np.where(norm > 0, norm, 1)
    return s.features.sparkSession.createDataFrame([(int(i), r.tolist()) for i, r in zip(s.columns, c, strict=True)], "id long, v array<double>")


def mean_projection(s: Spaco, means: DataFrame) -> DataFrame:
    """id, v: the component scores times the mean vector of each label, in order of the labels (label, v)."""
    m = np.array([r.v for r in means.orderBy("label").collect()])
    return s.project(s.loadings @ m.T)


def similarity_graph(vectors: DataFrame, k: int = 10) -> DataFrame:
    """a, b, w: cosine similarity of each vector's k - 1 nearest others (it is its own first), parallel edges added up."""
    near = graph.knn_vectors(vectors, k - 1, "cosine")
    return graph.undirected(near.withColumn("w", 1 - F.col("w")))


def kmeans(vectors: DataFrame, k: int, seed: int = 42, tries: int = 3, rounds: int = 50) -> DataFrame:
    """id, label of (id, v): the best of ``tries`` runs by the sum of squared distances, each from a scalable plus-plus start.

    Labels count from 0 by size, then smallest id, so they do not depend on the order in which centres were found. With fewer different vectors than
    ``k`` there are fewer groups. No rows, or ``k`` below 1, are an error, and so are vectors of unequal lengths.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 1:
        raise ValueError("there must be at least one group")
    rows = settled(vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features")))
    shapes = rows.agg(F.min(F.size(vector_to_array("features"))), F.max(F.size(vector_to_array("features")))).first()
    if shapes[0] is None or shapes[0] != shapes[1]:
        raise ValueError("vectors of one length are needed")
    if k == 1:
        return rows.select("id", F.lit(0).alias("label"))
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds, tol=1e-6).fit(rows) for i in range(tries)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    found = settled(best.transform(rows).select("id", F.col("prediction").alias("_l")))
    sizes = found.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).collect()  # k rows at most
    number = {r["_l"]: i for i, r in enumerate(sorted(sizes, key=lambda r: (-r.n, r.first)))}
    named = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    return found.select("id", named[F.col("_l")].alias("label"))


def groups(vectors: DataFrame, method: str = "kmeans", k: int | None = None, neighbours: int = 10, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """id, label of features (id, v) by the chosen method: "kmeans" into ``k`` groups (as many as a vector has numbers unless given), or "communities" of
    their cosine neighbours."""
    if method == "kmeans":
        return kmeans(vectors, k or len(vectors.first().v), seed)
    if method == "communities":
        return communities(similarity_graph(vectors, neighbours), resolution, seed)
    raise ValueError(f"unknown method {method}")
