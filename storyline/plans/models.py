"""Two embedding models side by side: each at the threshold that suits it, and how far their stories agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.operators import agreement
from storyline.operators.clustering import centroid_distances, cluster_at, merge_tree, unit_rows
from storyline.operators.stories import analyze, top_stories
from storyline.plans.evaluation import distance_percentiles, suggest_threshold, threshold_grid, threshold_sweep
from storyline.session import materialize


@dataclass
class Model:
    """What one model gives: percentiles of distances, the sweep, the chosen threshold of each issue, labels, and clusters."""

    distances: DataFrame
    sweep: DataFrame
    choice: DataFrame
    labels: DataFrame
    clusters: DataFrame


def evaluate_model(articles: DataFrame, keys: list[str], thresholds: list[float] | None = None, **options) -> Model:
    """Sweep, choose and label. One merge history serves all three; an issue is cut at its own threshold.

    ``articles`` has ``keys, seq, source, title, description, link, embedding``.
    """
    grid = thresholds or threshold_grid()
    tree = materialize(merge_tree(articles, keys, max(grid), **options), "tree")
    sweep = materialize(threshold_sweep(articles, keys, grid, tree=tree), "sweep")
    choice = materialize(suggest_threshold(sweep, keys), "choice")
    chosen = tree.join(choice.select(*keys, "threshold"), keys).select(*keys, "id", cluster_at(F.col("path"), F.col("id"), F.col("threshold")).alias("cluster_id"))
    vectors = unit_rows(articles, keys)
    near = centroid_distances(chosen.join(vectors.filter("vec is not null"), [*keys, "id"]), keys)
    alone = chosen.join(vectors.filter("vec is null").select(*keys, "id"), [*keys, "id"], "left_semi").withColumn("distance", F.lit(1.0))
    labels = materialize(near.unionByName(alone), "labels")
    clustered = articles.drop("embedding").join(labels.withColumnRenamed("id", "seq"), [*keys, "seq"])
    return Model(distance_percentiles(articles), sweep, choice, labels, materialize(analyze(clustered, keys), "clusters"))


@dataclass
class Comparison:
    """Agreement indexes (one row), the largest splits and merges from the first model to the second, and both rankings side by side."""

    indexes: DataFrame
    splits: DataFrame
    merges: DataFrame
    stories: DataFrame


def compare_models(a: Model, b: Model, keys: list[str]) -> Comparison:
    """Compare the labels of two models. An article that only one of them has takes no part; ``articles`` says how many both have."""
    on = [*keys, "id"]
    # A label is told by its issue too.
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys], F.col("cluster_id").cast("string"))
    left, right = (m.labels.select(*on, label.alias("label")) for m in (a, b))
    cells = materialize(agreement.contingency(left, right, on), "cells")
    # One row each.
    indexes = agreement.adjusted_rand(cells).crossJoin(agreement.nmi(cells)).crossJoin(cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("articles")))
    stories = agreement.top_stories_compare(*(top_stories(m.clusters, keys) for m in (a, b)))
    return Comparison(indexes, agreement.cluster_splits(left, right, on), agreement.cluster_splits(right, left, on), stories)
