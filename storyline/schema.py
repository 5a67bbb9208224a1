"""Fixed schemas of the tables that pass between steps.

``seq`` is the explicit row order (feed position, then entry position): every "first wins" rule ends in it.
"""

from pyspark.sql import types as T

#: Columns that name one issue: everything downstream of ingest is partitioned by them.
ISSUE = ["show", "issue_date"]

RAW_ENTRIES = T.StructType(
    [T.StructField("feed_id", T.StringType())]
    + [
        T.StructField(name, T.StringType())
        for name in ("title", "published", "description", "summary", "author", "link")
    ]
    + [T.StructField("seq", T.LongType())]
)

FEEDS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "feed_id",
            "name",
            "url",
            "country",
            "title_prefix",
            "title_suffix",
            "description_prefix",
            "description_suffix",
        )
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("published", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("show", T.StringType()),
        T.StructField("issue_date", T.DateType()),
    ]
)

#: Text columns an older article table may lack; they read as "".
ARTICLE_DEFAULTS = ["country", "description", "author", "link"]

EPISODES = T.StructType(
    [
        T.StructField("show", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("script", T.StringType()),
        T.StructField("audio_bytes", T.LongType()),
        T.StructField("duration_s", T.IntegerType()),
        T.StructField("has_sources_view", T.BooleanType()),
    ]
)
