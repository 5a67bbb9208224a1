"""Scores, representatives and classes of clusters.

Input: ``keys, seq, source, title, description, link, cluster_id`` and, for representatives, ``distance`` or ``embedding``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions.vectors import l2_normalize
from storyline.operators.clustering import centroid_distances
from storyline.operators.ordering import first_rows

# Class rules.
TOP_SIZE = 3
TOP_DIVERSITY = 0.3
JUNK_ABOVE = 2
PRINTED_STORIES = 20


def cluster_metrics(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Size, distinct sources, diversity and importance per cluster.

    Counting per source first keeps the second step at one row per cluster and source, whatever a cluster's size.
    """
    per_source = clustered.groupBy(*keys, "cluster_id", "source").agg(F.count("*").alias("n"))
    counted = per_source.groupBy(*keys, "cluster_id").agg(
        F.sum("n").alias("size"),
        F.count("*").alias("n_sources"),
        F.array_sort(F.collect_list("source")).alias("sources"),
    )
    diversity = F.col("n_sources") / F.col("size")
    return counted.withColumn("diversity_score", diversity).withColumn(
        "importance_score", F.col("size") * (0.5 + 0.5 * F.col("diversity_score"))
    )


def with_distances(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Each article's distance from the mean of its cluster; clustering brings it along already."""
    if "distance" in clustered.columns:
        return clustered
    return centroid_distances(clustered.withColumn("embedding", l2_normalize(F.col("embedding"))), keys, "embedding")


def medoids(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """The article nearest to the centroid, the first on ties: ``keys, cluster_id, medoid_seq, label, description``."""
    picked = F.min_by(
        F.struct(F.col("seq").alias("medoid_seq"), F.col("title").alias("label"), F.coalesce("description", F.lit("")).alias("description")),
        F.struct("distance", "seq"),
    )
    return (
        with_distances(clustered, keys)
        .groupBy(*keys, "cluster_id")
        .agg(picked.alias("m"))
        .select(*keys, "cluster_id", "m.*")
    )


def category() -> Column:
    return (
        F.when((F.col("size") > JUNK_ABOVE) & (F.col("n_sources") == 1), "junk")
        .when((F.col("size") >= TOP_SIZE) & (F.col("diversity_score") >= TOP_DIVERSITY), "top")
        .otherwise("niche")
    )


def categorize(metrics: DataFrame) -> DataFrame:
    """Class of a cluster: one source repeating itself, a widely covered story, or neither."""
    reason = F.when(
        F.col("category") == "junk", F.concat(F.lit("Single source ("), F.element_at("sources", 1), F.lit(")"))
    ).otherwise("")
    return metrics.withColumn("category", category()).withColumn("junk_reason", reason)


def story_order() -> list[Column]:
    return [F.col("importance_score").desc(), F.col("cluster_id")]


def analyze(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters with scores, representative and class."""
    scored = categorize(cluster_metrics(clustered, keys))
    return scored.join(medoids(clustered, keys), [*keys, "cluster_id"]).withColumn("is_junk", F.col("category") == "junk")


def top_stories(clusters: DataFrame, keys: list[str], limit: int = PRINTED_STORIES) -> DataFrame:
    """The most important top stories of each issue, with their rank."""
    return first_rows(clusters.filter("category = 'top'"), keys, story_order(), limit)


def analysis_summary(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Articles, clusters and singletons per issue."""
    totals = [
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_articles"),
        F.count("*").alias("total_clusters"),
        F.count_if(F.col("size") == 1).alias("singletons"),
    ]
    return clusters.groupBy(*keys).agg(*totals) if keys else clusters.agg(*totals)


def story_members(clustered: DataFrame, stories: DataFrame, keys: list[str]) -> DataFrame:
    """Articles of the given stories, with the story's rank."""
    fields = clustered.select(
        *keys, "cluster_id", "seq", "source", "title", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("link", F.lit("")).alias("link")
    )
    return fields.join(stories.select(*keys, "cluster_id", "rank"), [*keys, "cluster_id"])


def other_headlines(articles: DataFrame, clustered: DataFrame, clusters: DataFrame, keys: list[str], printed_only: bool = False) -> DataFrame:
    """Articles whose (source, title) is in no top story of their issue.

    All top stories count, not only those printed; ``printed_only`` limits it to the printed ones. The right side is
    made distinct first, so it is small and without repeats.
    """
    stories = top_stories(clusters, keys) if printed_only else clusters.filter("category = 'top'")
    told = (
        clustered.join(stories.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_semi")
        .select(*keys, F.col("source").alias("_source"), F.col("title").alias("_title"))
        .distinct()
    )
    for key in keys:
        told = told.withColumnRenamed(key, f"_{key}")
    match = F.col("source").eqNullSafe(F.col("_source")) & F.col("title").eqNullSafe(F.col("_title"))
    for key in keys:
        match = match & (F.col(key) == F.col(f"_{key}"))
    return articles.join(told, match, "left_anti")
