"""The ingest as a stream over landed entries: the same rules, batch by batch.

Two forms. :func:`stream_articles` passes each article on at once, so of two repeats the first to arrive stays.
:func:`collect_entries` keeps, for each batch, what can still be in the result: the newest entries of each feed. Such lists merge, and
their merge does not depend on how entries fell into batches or in which order they came; so :func:`collected_articles` equals the
batch ingest of all entries, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyline.functions.text import CleaningRules
from storyline.operators.ingest import FEED_LIMIT, MAX_AGE_DAYS, dedupe, newest_per_feed, select_entries, to_articles, validate, within_age


def stream_articles(
    entries: DataFrame,
    feeds: DataFrame,
    as_of: Column | None = None,
    max_age_days: int = MAX_AGE_DAYS,
    rules: CleaningRules = CleaningRules(),
    remember: str = "30 days",
) -> DataFrame:
    """Clean articles from a stream of entries, each (source, title) once.

    What is too old is told by ``as_of`` (the run's time, or null for no limit), never by other entries, so the result doesn't
    depend on the order or the size of batches, and an entry dated in the future does no harm. Repeats are known by arrival:
    ``remember`` is how long after the first one a repeat is left out, and bounds the state.
    ``feeds`` is a static table. Newest-per-feed stays with the daily batch, since a stream has no last row.
    """
    good = validate(entries).filter("reason is null").drop("reason")
    if as_of is not None:
        good = within_age(good, as_of, max_age_days)
    articles = to_articles(good, feeds, rules).withColumn("arrived", F.current_timestamp())
    return articles.withWatermark("arrived", remember).dropDuplicatesWithinWatermark(["source", "title"])


def start_ingest(articles: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the stream to parquet; each entry arrives exactly once through the checkpoint."""
    writer = articles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def collect_entries(
    entries: DataFrame,
    path: str,
    checkpoint: str,
    as_of: Column,
    max_age_days: int = MAX_AGE_DAYS,
    limit: int = FEED_LIMIT,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the good, recent and newest ``limit`` entries per feed of each batch, under ``path/batch=<number>``.

    A batch that runs again after a failure writes the same folder anew, so its entries count once. ``as_of`` is the run's time.
    """

    def keep(batch: DataFrame, number: int) -> None:
        select_entries(batch, as_of, max_age_days, limit).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = entries.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def collected_entries(
    spark: SparkSession, path: str, limit: int = FEED_LIMIT, earlier: DataFrame | None = None, after: int = -1, until: int | None = None
) -> DataFrame:
    """The newest ``limit`` entries per feed over the batches ``after`` one number and up to another, and over ``earlier``.

    To keep the number of batches small, save the result up to some batch; given later as ``earlier``, with that number as
    ``after``, it stands for those batches, which are not read again.
    """
    found = spark.read.parquet(path).filter(F.col("batch") > after)
    found = (found if until is None else found.filter(F.col("batch") <= until)).drop("batch")
    if earlier is not None:
        found = found.unionByName(earlier)
    return newest_per_feed(found, limit).drop("rank")


def collected_articles(collected: DataFrame, feeds: DataFrame, rules: CleaningRules = CleaningRules()) -> DataFrame:
    """Clean articles of :func:`collected_entries`, the first of each (source, title)."""
    return dedupe(to_articles(collected, feeds, rules))
