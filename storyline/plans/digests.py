"""Digest and prompt tables: ordered lines per issue, written as text without gathering an issue in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.operators.ordering import positions
from storyline.operators.stories import PRINTED_STORIES, story_members, top_stories
from storyline.schema import ISSUE
from storyline.session import materialize

# Wording of the digest and of the prompt.
DIGEST_TITLE = "# Coverage Pulse - "
NO_EPISODE = "No previous episode found."
INTRO = [
    "Here is the latest data for today's show:",
    "- In <previous_episode_transcript> find the script for the last episode for context.",
    '- In <clustered_headlines> find the "Top Stories" (widely covered).',
    "- In <other_headlines> find news that were only covered by single source.",
]

#: Order of lines: section, story rank, block within the story, row within the block.
LINE_ORDER = ["section", "rank", "block", "row"]


def _lines(df: DataFrame, keys: list[str], section: int, rank: Column, block: int, row: Column, line: Column) -> DataFrame:
    return df.select(
        *keys,
        F.lit(section).alias("section"),
        rank.cast("bigint").alias("rank"),
        F.lit(block).alias("block"),
        row.cast("bigint").alias("row"),
        line.alias("line"),
    )


def stories_digest(
    clustered: DataFrame, clusters: DataFrame, keys: list[str] = ISSUE, limit: int = PRINTED_STORIES, section: int = 0
) -> DataFrame:
    """Lines of the ranked digest: ``keys, section, rank, block, row, line``.

    Rank 0 is the heading, which every issue with clusters has.
    """
    # A few rows per issue, written so that the joins with articles know it.
    stories = materialize(top_stories(clusters, keys, limit), "stories")
    day = F.date_format("issue_date", "yyyy-MM-dd")
    heads = F.array(F.concat(F.lit(DIGEST_TITLE), day), F.lit(""))
    heading = clusters.select(*keys).distinct().select(*keys, F.posexplode(heads))
    context = F.when(
        F.col("description") != "",
        F.array(F.lit(""), F.concat(F.lit("> **Context:** "), F.col("description")), F.lit("")),
    ).otherwise(F.array(F.lit("")))
    head = F.concat(F.array(F.concat(F.lit("## "), F.col("rank"), F.lit(". "), F.col("label"))), context)
    opening = stories.select(*keys, "rank", F.posexplode(head))
    closing = stories.select(*keys, "rank", F.posexplode(F.array(F.lit(""), F.lit(""))))
    # The ranks stand apart from the stories' texts, so that their true size decides how they meet all articles.
    ranks = materialize(stories.select(*keys, "cluster_id", "rank"), "ranks")
    members = story_members(clustered, ranks, keys)
    told = F.concat(F.lit("- **"), _text("source"), F.lit("**: "), _text("title"), F.lit(" "), _text("description"))
    rank, pos, text = F.col("rank"), F.col("pos"), F.col("col")
    return (
        _lines(heading, keys, section, F.lit(0), 0, pos, text)
        .unionByName(_lines(opening, keys, section, rank, 1, pos, text))
        .unionByName(_lines(members, keys, section, rank, 2, F.col("seq"), told))
        .unionByName(_lines(closing, keys, section, rank, 3, pos, text))
    )


def _text(column: str) -> Column:
    """A part of a line; a null part is empty, so that the line stays."""
    return F.coalesce(F.col(column), F.lit(""))


def headline_blocks(articles: DataFrame, keys: list[str] = ISSUE) -> DataFrame:
    """One tagged block per article: ``keys, source, seq, line``; read in order of source, then ``seq``."""
    opening = F.concat(F.lit('<article source="'), _text("source"), F.lit('" date="'), _text("date"), F.lit('">\n'))
    body = F.when(_text("description") != "", F.concat(_text("title"), F.lit("\n"), "description")).otherwise(_text("title"))
    return articles.select(*keys, "source", "seq", F.concat(opening, body, F.lit("\n</article>")).alias("line"))


def headline_bullets(articles: DataFrame, keys: list[str] = ISSUE) -> DataFrame:
    """One bullet per article: ``keys, source, seq, line``."""
    line = F.concat(F.lit("* "), _text("date"), F.lit(": "), _text("title"))
    return articles.select(*keys, "source", "seq", line.alias("line"))


def short_context(articles: DataFrame, episodes: DataFrame, keys: list[str] = ISSUE) -> DataFrame:
    """The short prompt: a heading per source with its bullets, then the previous script.

    ``keys, section, source, seq, row, line``: read in this order. Section 0 holds the sources, section 1 the script.
    """
    bullets = headline_bullets(articles, keys)
    heads = bullets.select(*keys, "source").distinct()
    heads = heads.select(*keys, "source", F.posexplode(F.array(F.concat(F.lit("## "), _text("source")), F.lit(""))))
    previous = previous_episode(articles.select(*ISSUE).distinct(), episodes)
    script = F.array(F.lit(""), F.lit("# Previous Episode"), F.lit(""), F.col("previous_script"))
    last = previous.select(*keys, F.posexplode(script))
    line = lambda df, section, source, seq, row, text: df.select(
        *keys, F.lit(section).alias("section"), source.alias("source"), seq.cast("bigint").alias("seq"), row.cast("bigint").alias("row"), text.alias("line")
    )
    first = F.lit(-1)
    return (
        line(heads, 0, F.col("source"), first, F.col("pos"), F.col("col"))
        .unionByName(line(bullets, 0, F.col("source"), F.col("seq"), F.lit(0), F.col("line")))
        .unionByName(line(last, 1, F.lit(""), first, F.col("pos"), F.col("col")))
    )


def previous_episode(issues: DataFrame, episodes: DataFrame) -> DataFrame:
    """The script of the day before each issue: ``show, issue_date, previous_date, previous_script``.

    Exactly the day before counts; after a gap there is none.
    """
    before = episodes.select(
        "show", F.date_add("date", 1).alias("issue_date"), F.col("script").alias("previous_script")
    )
    return issues.join(before, ["show", "issue_date"], "left").select(
        "show",
        "issue_date",
        F.date_sub("issue_date", 1).alias("previous_date"),
        F.coalesce("previous_script", F.lit(NO_EPISODE)).alias("previous_script"),
    )


def briefing_context(
    articles: DataFrame, clustered: DataFrame, clusters: DataFrame, others: DataFrame, episodes: DataFrame
) -> DataFrame:
    """All lines of the prompt: ``show, issue_date, section, rank, block, row, line``.

    ``others`` are the articles outside top stories. Lines keep their place by number, so the table can be written
    in order by :func:`write_lines` at any size.
    """
    issues = articles.select(*ISSUE).distinct()
    previous = previous_episode(issues, episodes)
    day = F.date_format("previous_date", "yyyy-MM-dd")
    transcript = F.array(
        *[F.lit(line) for line in INTRO],
        F.lit(""),
        F.lit("<previous_episode_transcript>"),
        F.concat(F.lit("# Previous Episode Transcript ("), day, F.lit(")")),
        F.col("previous_script"),
        F.lit("</previous_episode_transcript>"),
        F.lit(""),
        F.lit("<clustered_headlines>"),
    )
    zero = F.lit(0)
    opening = _lines(previous.select(*ISSUE, F.posexplode(transcript)), ISSUE, 0, zero, 0, F.col("pos"), F.col("col"))
    digest = stories_digest(clustered, clusters, ISSUE, section=1)
    between = F.array(F.lit("</clustered_headlines>"), F.lit(""), F.lit("<other_headlines>"))
    middle = _lines(issues.select(*ISSUE, F.posexplode(between)), ISSUE, 2, zero, 0, F.col("pos"), F.col("col"))
    placed = positions(headline_blocks(others), ISSUE, [F.col("source"), F.col("seq")], key=["source", "seq"])
    headlines = _lines(placed, ISSUE, 3, zero, 0, F.col("position"), F.col("line"))
    closing = _lines(issues, ISSUE, 4, zero, 0, zero, F.lit("</other_headlines>"))
    return opening.unionByName(digest).unionByName(middle).unionByName(headlines).unionByName(closing)


def write_lines(lines: DataFrame, path: str, order: list[str] = LINE_ORDER) -> None:
    """Text files per issue; the files of an issue, in name order, hold its lines in order."""
    spread = lines.repartitionByRange(*ISSUE, *order).sortWithinPartitions(*ISSUE, *order)
    spread.select(*ISSUE, "line").write.partitionBy(*ISSUE).mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).text(path)
