"""Story cards, the listing of unclustered articles, and the totals of the sources view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions.dates import time_display, view_published, wall_clock
from storyline.functions.links import extract_domain
from storyline.functions.text import preview
from storyline.operators.clustering import with_cluster_size
from storyline.operators.ordering import first_rows, positions
from storyline.operators.stories import cluster_metrics, medoids, story_order
from storyline.schema import ISSUE
from storyline.session import materialize

# Fixed value: icons shown on a card.
CARD_ICONS = 6


def with_view_columns(articles: DataFrame, strict_view: bool = False) -> DataFrame:
    """Add what the view shows: ``domain, view_time, time_display, preview``."""
    instant = view_published(F.col("date"), strict_view)
    wall = F.when(F.col("view_time").isNotNull(), wall_clock(F.col("date")))
    return articles.withColumn("view_time", instant).withColumns(
        {
            "domain": extract_domain(F.col("link")),
            "time_display": time_display(wall, F.col("issue_date")),
            "preview": preview(F.coalesce("description", F.lit(""))),
        }
    )


def newest_first() -> list[Column]:
    """Newest article first; an unreadable date counts as the epoch."""
    return [F.coalesce("view_time", F.timestamp_seconds(F.lit(0))).desc(), F.col("seq")]


def story_domains(viewed: DataFrame, keys: list[str] = ISSUE, limit: int = CARD_ICONS) -> DataFrame:
    """The domains of a story, newest first, one per source: the first ``limit`` and how many more there are."""
    age = -F.unix_micros(F.coalesce("view_time", F.timestamp_seconds(F.lit(0))))
    per_source = (
        viewed.filter("domain <> ''")
        .groupBy(*keys, "cluster_id", "source")
        .agg(F.min(F.struct(age.alias("age"), "seq", "domain")).alias("newest"))
        .select(*keys, "cluster_id", "newest.*")
    )
    total = per_source.groupBy(*keys, "cluster_id").agg(F.count("*").alias("domains"))
    shown = (
        first_rows(per_source, [*keys, "cluster_id"], [F.col("age"), F.col("seq")], limit)
        .groupBy(*keys, "cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "domain"))).alias("shown"))
    )
    return shown.join(total, [*keys, "cluster_id"]).select(
        *keys,
        "cluster_id",
        F.transform("shown", lambda s: s["domain"]).alias("icons"),
        F.greatest(F.col("domains") - limit, F.lit(0)).alias("more"),
    )


def story_cards(clustered: DataFrame, keys: list[str] = ISSUE, strict_view: bool = False) -> DataFrame:
    """One row per story of two or more articles, ranked by importance."""
    metrics = cluster_metrics(clustered, keys).drop("sources").filter("size >= 2")
    domains = story_domains(with_view_columns(clustered.drop("embedding"), strict_view), keys)
    cards = metrics.join(medoids(clustered, keys), [*keys, "cluster_id"]).join(domains, [*keys, "cluster_id"], "left")
    cards = cards.withColumns(
        {"icons": F.coalesce("icons", F.array().cast("array<string>")), "more": F.coalesce("more", F.lit(0))}
    )
    return positions(cards, keys, story_order(), "rank")


def card_articles(clustered: DataFrame, keys: list[str] = ISSUE, strict_view: bool = False) -> DataFrame:
    """The articles under each card, newest first, with their position."""
    shared = with_cluster_size(clustered.drop("embedding"), keys).filter("cluster_size >= 2").drop("cluster_size")
    return positions(with_view_columns(shared, strict_view), [*keys, "cluster_id"], newest_first(), key=["view_time", "seq"])


def unclustered_by_source(clustered: DataFrame, keys: list[str] = ISSUE, strict_view: bool = False) -> DataFrame:
    """Articles of no story: the busiest source first, then by name; within a source newest first, then by title."""
    alone = with_cluster_size(clustered.drop("embedding"), keys).filter("cluster_size = 1").drop("cluster_size")
    viewed = with_view_columns(alone, strict_view)
    counts = viewed.groupBy(*keys, "source").agg(F.count("*").alias("source_articles"))
    ranked = positions(counts, keys, [F.col("source_articles").desc(), F.col("source")], "source_rank")
    newest, seq = newest_first()
    placed = positions(viewed, [*keys, "source"], [newest, F.col("title"), seq])
    return placed.join(ranked, [*keys, "source"])


def view_stats(clustered: DataFrame, keys: list[str] = ISSUE) -> DataFrame:
    """Totals of the view: articles, sources, stories, and the share that is in a story."""
    per_source = (
        with_cluster_size(clustered.select(*keys, "cluster_id", "source"), keys)
        .groupBy(*keys, "source", "cluster_id")
        .agg(F.count("*").alias("n"), F.max("cluster_size").alias("cluster_size"))
    )
    shared = F.col("cluster_size") >= 2
    totals = per_source.groupBy(*keys).agg(
        F.sum("n").alias("total_articles"),
        F.count_distinct("source").alias("source_count"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("clustered_count"),
        F.count_distinct(F.when(shared, F.col("cluster_id"))).alias("cluster_count"),
    )
    percent = F.bround(100 * F.col("clustered_count") / F.col("total_articles"), 0).cast("bigint")
    return totals.withColumn("unclustered_count", F.col("total_articles") - F.col("clustered_count")).withColumn(
        "clustered_pct", F.when(F.col("total_articles") > 0, percent).otherwise(F.lit(0))
    )


def sources_view(clustered: DataFrame, keys: list[str] = ISSUE, strict_view: bool = False) -> dict[str, DataFrame]:
    """The tables a sources page shows."""
    return {
        "cards": story_cards(clustered, keys, strict_view),
        "articles": card_articles(clustered, keys, strict_view),
        "unclustered": unclustered_by_source(clustered, keys, strict_view),
        "stats": view_stats(clustered, keys),
    }


def source_listing(articles: DataFrame, keys: list[str] = ISSUE) -> DataFrame:
    """Articles grouped by source, sources by name: each row knows its place and its source's count."""
    named = articles.filter(F.col("source").isNotNull())
    counts = materialize(named.groupBy(*keys, "source").agg(F.count("*").alias("source_articles")), "counts")
    return positions(named, [*keys, "source"], [F.col("seq")], key=["seq"]).join(counts, [*keys, "source"])
