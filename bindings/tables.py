"""The given tables seen as articles, entries, episodes and labelled vectors. Whole tables, whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.functions.dates import mail_date
from storyline.functions.text import collapse_spaces
from storyline.operators.embed import register_provider
from storyline.session import prepare

#: When the batch of events is taken in.
AS_OF = "2024-01-31 00:00:00"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _minutes_after_start(number: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + number * 420)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split at the first line break: the line is the title, the rest the description."""
    text = F.col("text")
    rest = F.when(text.contains("\n"), F.substr(text, F.locate("\n", text) + 1)).otherwise("")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        "source",
        "lang",
        F.substring_index(text, "\n", 1).alias("title"),
        rest.alias("rest"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, a few hundred per issue."""
    published = _minutes_after_start(F.col("seq"))
    return titled(spark, sf_dir).select(
        "source",
        mail_date(published).alias("date"),
        "title",
        F.col("lang").alias("country"),
        collapse_spaces(F.col("rest")).alias("description"),
        F.lit("").alias("author"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.org/"), F.col("seq").cast("string")).alias("link"),
        published.alias("published"),
        "seq",
        F.lit("documents").alias("show"),
        published.cast("date").alias("issue_date"),
    )


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw feed entries: feeds with an even number come through an aggregator, which adds its name."""
    listed = F.substr("source", F.lit(4)).cast("int") % 2 == 0
    title = F.when(listed, F.concat("title", F.lit(" - "), "source")).otherwise(F.col("title"))
    return titled(spark, sf_dir).select(
        F.col("source").alias("feed_id"),
        title.alias("title"),
        mail_date(_minutes_after_start(F.col("seq"))).alias("published"),
        F.when(F.col("seq") % 2 == 0, F.col("rest")).alias("description"),
        F.col("rest").alias("summary"),
        F.concat("lang", F.lit("@example.org ("), "source", F.lit(")")).alias("author"),
        F.concat(F.lit("https://example.org/"), F.col("seq").cast("string")).alias("link"),
        "seq",
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per document source."""
    number = F.substr("source", F.lit(4)).cast("int")
    third = number % 3 == 0
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            F.col("source").alias("feed_id"),
            F.col("source").alias("name"),
            F.when(number % 2 == 0, F.concat(F.lit("https://news.google.com/rss?q="), "source"))
            .otherwise(F.concat(F.lit("https://example.org/"), "source"))
            .alias("url"),
            F.when(third, "[A-Za-z]+ ").alias("title_prefix"),
            F.when(third, "[.!?]+").alias("title_suffix"),
            F.when(third, "^[A-Z]").alias("description_prefix"),
            F.when(third, " [a-z]+[.]").alias("description_suffix"),
        )
    )


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw entries of one feed per type; some lack a title or a readable date."""
    last = F.col("event_id") % 10
    stamp = mail_date(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed_id"),
        F.when(last == 0, "").otherwise(F.concat_ws(" ", "event_type", "user_id")).alias("title"),
        F.when(last == 1, F.lit(None)).when(last == 2, "soon").otherwise(stamp).alias("published"),
        F.col("props").alias("description"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("link"),
        F.col("event_id").alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one large issue."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("all").alias("show"),
        F.to_date(F.lit("2024-01-01")).alias("issue_date"),
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("title"),
        F.lit("").alias("description"),
        F.lit("").alias("link"),
        "embedding",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors beside the document of the same number, with the given label as the cluster, in twelve issues."""
    found = titled(spark, sf_dir).select(
        F.col("seq").alias("vec_id"), F.col("lang").alias("source"), "title", collapse_spaces(F.col("rest")).alias("description")
    )
    number = F.col("vec_id")
    published = _minutes_after_start(number)
    source = F.coalesce("source", F.lit("none"))
    link = F.concat(F.lit("https://www."), source, F.lit(".example.org/"), number.cast("string"))
    return (
        table(spark, sf_dir, "embeddings")
        .join(found, "vec_id", "left")
        .select(
            (number % 3).cast("string").alias("show"),
            F.date_add(F.to_date(F.lit("2024-01-02")), (number % 4).cast("int")).alias("issue_date"),
            number.alias("seq"),
            source.alias("source"),
            F.coalesce("title", F.concat(F.lit("v"), number.cast("string"))).alias("title"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.when(number % 5 == 0, "").otherwise(link).alias("link"),
            F.concat(F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0100")).alias("date"),
            "embedding",
            F.col("label").cast("bigint").alias("cluster_id"),
        )
    )


def given_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two label sets of the vectors: ``seq, label``."""
    rows = table(spark, sf_dir, "embeddings")
    a = rows.select(F.col("vec_id").alias("seq"), F.col("label").cast("bigint").alias("label"))
    b = rows.select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 10).alias("label"))
    return a, b


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns as daily episodes; after every third there is a day without one."""
    day = F.col("turn") + F.floor(F.col("turn") / 3)
    return (
        table(spark, sf_dir, "conversations")
        .select(
            F.col("conv_id").cast("string").alias("show"),
            F.date_add(F.to_date(F.lit("2024-01-01")), day.cast("int")).alias("date"),
            F.col("text").alias("script"),
            F.octet_length("text").cast("bigint").alias("audio_bytes"),
            (F.length("text") / 15).cast("int").alias("duration_s"),
            (F.col("role") == "assistant").alias("has_sources_view"),
        )
    )


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = F.col("conv_id").cast("string")
    return (
        table(spark, sf_dir, "conversations")
        .select(show.alias("show"))
        .distinct()
        .select("show", F.concat(F.lit("Show "), "show").alias("name"), F.concat(F.lit("https://example.org/"), "show").alias("base_url"))
    )


def letter_counts():
    """A provider whose vectors SQL can check: how often each letter occurs in the whole text."""

    def call(texts: Sequence[str]) -> list[list[float]]:
        return [[float(text.count(letter)) for letter in LETTERS] for text in texts]

    return call


register_provider("letters", letter_counts)
