"""Landed feed files and the feed dimension."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyline.functions.text import CleaningRules
from storyline.schema import FEEDS
from storyline.session import even_parts, materialize

#: Elements of a feed item that are read; the author may stand in either of two.
ITEM = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("title", "pubDate", "description", "summary", "author", "dc:creator", "link")
    ]
    + [T.StructField("_corrupt_record", T.StringType())]
)


#: Elements of an Atom entry that are read.
ENTRY = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("title", "published", "summary", "content")]
    + [
        T.StructField("author", T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType())])),
        T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType())]))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
COLUMNS = ["title", "published", "description", "summary", "author", "link"]


def _tagged(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    items = (
        spark.read.format("xml")
        .option("rowTag", tag)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("ignoreCorruptFiles", "true")
        .schema(schema)
        .load(path)
    )
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return items.select("*", *place, F.monotonically_increasing_id().alias("_read")).withColumn("feed_id", F.col("feed_id").cast("string"))


def _items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS and entries of Atom under the same names. A feed file has one of the two forms."""
    kept = ["feed_id", "_corrupt_record", "_file", "_block", "_read"]
    rss = _tagged(spark, path, "item", ITEM).withColumns({"author": F.coalesce("author", "`dc:creator`"), "published": F.col("pubDate")})
    # The page itself is the link that is named so or has no name.
    pages = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    name, mail = F.col("author.name"), F.col("author.email")
    author = F.when(name.isNotNull() & mail.isNotNull(), F.concat(name, F.lit(" ("), mail, F.lit(")"))).otherwise(F.coalesce(name, mail))
    atom = _tagged(spark, path, "entry", ENTRY).withColumns(
        {
            "description": F.lit(None).cast("string"),
            "summary": F.coalesce("summary", "content"),
            "author": author,
            "link": F.try_element_at(pages, F.lit(1))["_href"],
        }
    )
    return rss.select(*COLUMNS, *kept).unionByName(atom.select(*COLUMNS, *kept))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all landed feeds, RSS and Atom, laid out as ``feed_id=<id>/*.xml``.

    A broken item is left out (``read_rejects`` lists it, ``audit_feeds`` counts files too) and the other items and feeds go on. ``seq``
    rises in the order of feed, file name and item; it is not dense. Entries are written once, so that ``seq`` stays the same
    however often they are read.
    """
    order = ["feed_id", "_file", "_block", "_read"]
    items = _items(spark, path).filter(F.col("_corrupt_record").isNull())
    entries = items.repartitionByRange(*order).sortWithinPartitions(*order).select("feed_id", *COLUMNS, F.monotonically_increasing_id().alias("seq"))
    return materialize(entries, "entries")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_rss`` leaves out: ``feed_id, file, reason, title, item``, the title if it was readable.

    Items before the broken place of a file are read; the reader gives the broken document whole, once for each form it looks for.
    """
    broken = _items(spark, path).filter(F.col("_corrupt_record").isNotNull())
    found = broken.select("feed_id", F.col("_file").alias("file"), F.lit("Broken item").alias("reason"), "title", F.col("_corrupt_record").alias("item"))
    return found.distinct()


def audit_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Per feed, what was landed and what was read: ``feed_id, files, broken_files, empty_files, items, untitled_items``.

    The listing of files (their content is not read again) is held against what came out of them. A broken file has a place that can't
    be read, an empty one gave no item, whether broken, no feed at all, or without items; so a feed of which nothing could be
    read is in the result too.
    """
    broken, plain = F.col("_corrupt_record").isNotNull(), lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    listed = spark.read.format("binaryFile").load(path).select(plain("path").alias("_file"), F.col("feed_id").cast("string").alias("feed_id"))
    counts = _items(spark, path).groupBy("feed_id", plain("_file").alias("_file")).agg(
        F.count_if(~broken).alias("good"), F.count_if(~broken & F.col("title").isNull()).alias("untitled"), F.bool_or(broken).alias("broken")
    )
    good, untitled = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("good", "untitled"))
    return listed.join(counts, ["feed_id", "_file"], "left").groupBy("feed_id").agg(
        F.count("*").alias("files"),
        F.count_if("broken").alias("broken_files"),
        F.count_if(good == 0).alias("empty_files"),
        F.sum(good).alias("items"),
        F.sum(untitled).alias("untitled_items"),
    )


def write_atom(entries: DataFrame, path: str) -> None:
    """Land entries as Atom files beside what is there, one folder per feed, as :func:`write_rss` does."""
    link = F.array(F.struct(F.col("link").alias("_href"), F.lit("alternate").alias("_rel")))
    items = entries.select("feed_id", "seq", "title", "published", "summary", F.col("description").alias("content"), F.struct(F.col("author").alias("name")).alias("author"), link.alias("link"))
    spread = items.repartitionByRange(even_parts(items), "feed_id", "seq").sortWithinPartitions("feed_id", "seq").drop("seq")
    spread.write.mode("append").partitionBy("feed_id").format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)


def write_rss(entries: DataFrame, path: str) -> None:
    """Land entries as feed files, one folder per feed; a big feed is spread over several files."""
    items = entries.select(
        "feed_id", "seq", "title", F.col("published").alias("pubDate"), "description", "summary", "author", "link"
    )
    spread = items.repartitionByRange(even_parts(items), "feed_id", "seq").sortWithinPartitions("feed_id", "seq").drop("seq")
    spread.write.partitionBy("feed_id").format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)


def feed_dim(feeds: DataFrame) -> DataFrame:
    """The feed dimension with its fixed columns; a missing pattern is null, a missing text "".

    It is written once, so that Spark knows its size: a small one is broadcast to the entries, which then are not
    shuffled, and one beyond the broadcast limit is joined by shuffle.
    """
    have = set(feeds.columns)
    column = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    texts = {"url", "country"}
    return materialize(
        feeds.select(
            *[(F.coalesce(column(f.name), F.lit("")) if f.name in texts else column(f.name)).alias(f.name) for f in FEEDS.fields]
        ),
        "feeds",
    )


def feeds_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """Feed rows of a parsed show configuration; ``name``, ``url`` and ``country`` are required."""
    rows = []
    for feed in config.get("feeds", []):
        patterns = feed.get("cleaning", {})
        rows.append(
            (feed["name"], feed["name"], feed["url"], feed["country"])
            + tuple(patterns.get(f.name) for f in FEEDS.fields[4:])
        )
    return spark.createDataFrame(rows, FEEDS)


def cleaning_from_config(config: dict) -> CleaningRules:
    """Cleaning rules of a parsed show configuration; absent keys keep their defaults."""
    given = config.get("cleaning", {})
    names = {f.name for f in dataclasses.fields(CleaningRules)}
    return CleaningRules(**{k: tuple(v) if k == "empty_values" else v for k, v in given.items() if k in names})
