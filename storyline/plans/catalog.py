"""The episode catalog: episodes to feed items to catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.functions import text as X
from storyline.operators.ordering import positions
from storyline.sources.episodes import read_episode_feed, write_episode_feed
from storyline.session import materialize, new_path


def catalog_rows(entries: DataFrame) -> DataFrame:
    """Catalog entries, newest first within a show, with the blurb the page shows.

    Entries are written first: the range shuffle of the positions samples what it reads, and would parse each feed file twice.
    """
    placed = positions(materialize(entries, "entries"), ["show"], [F.col("published").desc(), F.col("title")])
    return placed.withColumn("blurb", X.truncate_words(F.col("description")))


def episode_catalog(items: DataFrame, path: str | None = None) -> DataFrame:
    """Write the episode feeds and read the catalog back out of them."""
    spark = items.sparkSession
    path = path or new_path(spark, "episode-feed")
    write_episode_feed(items, path)
    return catalog_rows(read_episode_feed(spark, path))


def script_budget(episodes: DataFrame, limit: int = X.SPEECH_LIMIT) -> DataFrame:
    """What is spoken of each script: the text up to the limit, its full length, and whether it was cut."""
    return episodes.withColumns(
        {
            "spoken": X.speech_text(F.col("script"), limit),
            "script_length": F.length("script"),
            "is_cut": F.length("script") > limit,
        }
    )
