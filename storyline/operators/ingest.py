"""From feed entries to clean, de-duplicated articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.functions import text as X
from storyline.functions.dates import parse_published
from storyline.operators.ordering import first_per_key, first_rows

# Reasons for refusing an entry, and the newest entries kept per feed.
MISSING_TITLE = "Missing title"
MISSING_DATE = "Missing published date"
BAD_DATE = "Invalid date format"
FEED_LIMIT = 150
MAX_AGE_DAYS = 1


def _missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def validate(entries: DataFrame) -> DataFrame:
    """Add ``published_at`` and ``reason``; a null reason means the entry is good. The raw title is tested."""
    instant = parse_published(F.col("published"))
    reason = (
        F.when(_missing("title"), MISSING_TITLE)
        .when(_missing("published"), MISSING_DATE)
        .when(F.col("published_at").isNull(), BAD_DATE)
    )
    return entries.withColumn("published_at", instant).withColumn("reason", reason)


def within_age(entries: DataFrame, as_of: Column, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Entries at most ``max_age_days`` old at ``as_of``, the edge included."""
    return entries.filter(_recent(as_of, max_age_days))


def _recent(as_of: Column, max_age_days: int) -> Column:
    return F.col("published_at") >= as_of - F.make_dt_interval(days=F.lit(max_age_days))


def newest_per_feed(entries: DataFrame, limit: int = FEED_LIMIT, feed: str = "feed_id") -> DataFrame:
    """The newest entries of each feed; entries of one instant keep their order."""
    return first_rows(entries, [feed], [F.col("published_at").desc(), F.col("seq")], limit)


def clean_article(joined: DataFrame, rules: X.CleaningRules = X.CleaningRules()) -> DataFrame:
    """Clean ``title`` and ``description`` by the rules of their feed.

    ``joined`` holds ``name, url`` and the four feed patterns beside each entry. The steps follow one another:
    aggregator suffix, feed patterns, ends, then the tests that blank a description.
    """
    title, description = F.col("title"), F.col("description")
    if rules.google_news_auto_clean:
        listed = X.is_aggregator(F.col("url"))
        title = F.when(listed, X.strip_name_from_title(title, F.col("name"))).otherwise(title)
        description = F.when(listed, X.strip_name_from_description(description, F.col("name"))).otherwise(description)
    patterned = joined.withColumns({"title": title, "description": description}).withColumns(
        {
            "title": X.strip_prefix_pattern(F.col("title"), F.col("title_prefix")),
            "description": X.strip_prefix_pattern(F.col("description"), F.col("description_prefix")),
        }
    )
    stripped = patterned.withColumns(
        {
            "title": X.strip(X.strip_suffix_pattern(F.col("title"), F.col("title_suffix"))),
            "description": X.strip(X.strip_suffix_pattern(F.col("description"), F.col("description_suffix"))),
        }
    )
    return stripped.withColumn("description", X.blank_useless(F.col("description"), F.col("title"), rules))


def with_feeds(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries beside their feed. The feed table's size decides at run time whether it is broadcast."""
    return entries.join(feeds, "feed_id")


def to_articles(entries: DataFrame, feeds: DataFrame, rules: X.CleaningRules = X.CleaningRules()) -> DataFrame:
    """Cleaned articles, one row per entry, before de-duplication."""
    extra = [c for c in ("show", "issue_date") if c in entries.columns]
    plain = with_feeds(entries, feeds).withColumns(
        {
            "title": X.clean_html(F.col("title")),
            "description": X.clean_html(X.description_or_summary(F.col("description"), F.col("summary"))),
            "author": X.clean_author(F.col("author")),
        }
    )
    return clean_article(plain, rules).select(
        F.col("name").alias("source"),
        F.col("published").alias("date"),
        "title",
        F.coalesce("country", F.lit("")).alias("country"),
        "description",
        "author",
        F.coalesce("link", F.lit("")).alias("link"),
        F.col("published_at").alias("published"),
        "seq",
        *extra,
    )


def dedupe(articles: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """The first article of each (source, title)."""
    return first_per_key(articles, [*(scope or []), "source", "title"], [F.col("seq")])


def removed_count(articles: DataFrame, unique: DataFrame) -> DataFrame:
    """How many duplicates went, per source."""
    before = articles.groupBy("source").agg(F.count("*").alias("articles"))
    after = unique.groupBy("source").agg(F.count("*").alias("kept"))
    return before.join(after, "source", "left").select(
        "source", "articles", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("articles") - F.coalesce("kept", F.lit(0))).alias("removed"),
    )


def validation_stats(validated: DataFrame) -> DataFrame:
    """Refused entries by reason."""
    return validated.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("entries"))


def feed_stats(
    validated: DataFrame, as_of: Column, max_age_days: int = MAX_AGE_DAYS, limit: int = FEED_LIMIT
) -> DataFrame:
    """Per feed: entries seen, refused, recent, and kept after the limit. One pass with partial counts."""
    good = F.col("reason").isNull()
    recent = F.count_if(good & F.coalesce(_recent(as_of, max_age_days), F.lit(False)))
    return (
        validated.groupBy("feed_id")
        .agg(F.count("*").alias("total"), F.count_if(~good).alias("failed"), recent.alias("recent"))
        .withColumn("kept", F.least("recent", F.lit(limit).cast("bigint")))
    )


def select_entries(
    entries: DataFrame, as_of: Column, max_age_days: int = MAX_AGE_DAYS, limit: int = FEED_LIMIT
) -> DataFrame:
    """Good, recent and newest entries; only these are cleaned."""
    good = validate(entries).filter("reason is null").drop("reason")
    return newest_per_feed(within_age(good, as_of, max_age_days), limit).drop("rank")


def ingest(
    entries: DataFrame,
    feeds: DataFrame,
    as_of: Column,
    max_age_days: int = MAX_AGE_DAYS,
    limit: int = FEED_LIMIT,
    rules: X.CleaningRules = X.CleaningRules(),
) -> DataFrame:
    """One batch of entries to the articles of an issue."""
    return dedupe(to_articles(select_entries(entries, as_of, max_age_days, limit), feeds, rules))


def union_feeds(*tables: DataFrame) -> DataFrame:
    """All feeds' articles in one table; columns match by name, a missing one is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def group_by_source(articles: DataFrame) -> DataFrame:
    """Number of articles per source; the articles stay rows, see :func:`~storyline.plans.views.source_listing`."""
    return articles.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("articles"))
