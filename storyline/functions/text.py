"""Text cleaning and shaping as column expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Defaults and patterns that results depend on.
EMPTY_VALUES = ("undefined", "Continua a leggere", "Read more", "")
MIN_DESCRIPTION_LENGTH = 15
CLUSTER_THRESHOLD = 0.40
EMBEDDING_PROVIDER = "openai"
AGGREGATOR_HOST = "news.google.com"
TAG = r"<[^>]+>"
MAIL_AND_NAME = r"^[^\s]+@[^\s]+\s+\((.+)\)$"
BYLINE = r"(?i)^di\s+"
SEPARATORS = r"(?U)[\s\-–—|]+"
SOURCES_HEADER = r"^View all sources: (https?://[^\s]+)\s*\n---\n+"
PREVIEW_LENGTH = 180
SPEECH_LIMIT = 5000

# Entities replaced by Spark itself; rows with any other go to the unescape function.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&middot;": "·",
    "&amp;": "&",
}

#: What counts as white space: the Unicode property and the four separators Python also splits on.
SPACE = r"[\s\x1c-\x1f]"

#: The same as single characters, and the separators that a comparison of texts ignores.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
IGNORED = SPACES + "-–—|"


@dataclass(frozen=True)
class CleaningRules:
    """Parameters of article cleaning and grouping for one show."""

    empty_values: Sequence[str] = EMPTY_VALUES
    min_description_length: int = MIN_DESCRIPTION_LENGTH
    dedupe_title_description: bool = True
    google_news_auto_clean: bool = True
    cluster_threshold: float = CLUSTER_THRESHOLD
    embedding_provider: str = EMBEDDING_PROVIDER


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    """HTML entities to characters, in one pass.

    Texts without ``&`` stay as they are, the common entities are replaced by Spark, and only rows that hold another
    ``&`` are sent to Python.
    """
    names = "|".join(entity[1:-1] for entity in COMMON_ENTITIES)
    rare = text.contains("&") & F.regexp_replace(text, f"&({names});", "").contains("&")
    native = text
    for entity, character in COMMON_ENTITIES.items():
        native = F.replace(native, F.lit(entity), F.lit(character))
    return F.coalesce(_unescape(F.when(rare, text)), F.when(text.contains("&"), native), text)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.trim(text, F.lit(SPACES))


def clean_html(text: Column) -> Column:
    """Unescape, delete tags, collapse white space; null reads as ""."""
    plain = unescape_html(text)
    untagged = F.when(plain.contains("<"), F.regexp_replace(plain, TAG, "")).otherwise(plain)
    return F.coalesce(collapse_spaces(untagged), F.lit(""))


def clean_author(author: Column) -> Column:
    """The person's name out of ``mail (Name)``, without a leading "di "."""
    name = F.regexp_replace(clean_html(author), MAIL_AND_NAME, "$1")
    return strip(F.regexp_replace(name, BYLINE, ""))


def is_aggregator(url: Column) -> Column:
    return F.coalesce(url.contains(AGGREGATOR_HOST), F.lit(False))


def _without_tail(text: Column, name: Column) -> Column:
    return F.rtrim(F.left(text, F.length(text) - F.length(name)))


def strip_name_from_title(title: Column, name: Column) -> Column:
    """``Headline - Name`` to ``Headline``; expects collapsed white space, so no pattern is compiled per row."""
    head = _without_tail(title, name)
    return F.when(
        F.endswith(title, name) & F.endswith(head, F.lit("-")),
        F.rtrim(F.left(head, F.length(head) - 1)),
    ).otherwise(title)


def strip_name_from_description(description: Column, name: Column) -> Column:
    """``Text Name`` to ``Text``; expects collapsed white space."""
    before = F.left(description, F.length(description) - F.length(name))
    return F.when(
        F.endswith(description, name) & F.endswith(before, F.lit(" ")), F.rtrim(before)
    ).otherwise(description)


def strip_prefix_pattern(text: Column, pattern: Column) -> Column:
    """Remove a feed's own prefix pattern; a null or empty pattern changes nothing."""
    wanted = F.coalesce(pattern, F.lit("")) != ""
    return F.when(wanted, F.regexp_replace(text, F.concat(F.lit("(?U)^"), pattern), F.lit(""))).otherwise(text)


def strip_suffix_pattern(text: Column, pattern: Column) -> Column:
    wanted = F.coalesce(pattern, F.lit("")) != ""
    return F.when(wanted, F.regexp_replace(text, F.concat(F.lit("(?U)"), pattern, F.lit("$")), F.lit(""))).otherwise(text)


def comparison_form(text: Column) -> Column:
    """Lower case with runs of spaces, dashes and bars as one space."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def same_text(a: Column, b: Column) -> Column:
    """Equal up to case, white space, dashes and bars. The first letters decide most rows before the full test."""
    first = lambda c: F.left(F.ltrim(F.lower(c), F.lit(IGNORED)), F.lit(1))
    return (first(a) == first(b)) & (comparison_form(a) == comparison_form(b))


def blank_useless(description: Column, title: Column, rules: CleaningRules) -> Column:
    """"" for a filler, too short or title-repeating description."""
    useless = description.isin(list(rules.empty_values)) | (
        F.length(description) < rules.min_description_length
    )
    if rules.dedupe_title_description:
        useless = useless | same_text(description, title)
    return F.when(useless, F.lit("")).otherwise(description)


def description_or_summary(description: Column, summary: Column) -> Column:
    return F.coalesce(F.nullif(description, F.lit("")), F.nullif(summary, F.lit("")), F.lit(""))


def embedding_text(title: Column, description: Column) -> Column:
    """``Title. Description``, or the title alone when there is no description."""
    head, tail = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(description, F.lit("")))
    return F.when(tail.isin("", "nan"), head).otherwise(F.concat(head, F.lit(". "), tail))


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def truncate_words(text: Column, length: int = 500, leeway: int = 5) -> Column:
    """Cut at a word end so that the text with "..." fits ``length``; a small overrun is left alone."""
    cut = F.regexp_replace(F.left(text, F.lit(length - 3)), r" [^ ]*\z", "")
    return F.when(F.length(text) <= length + leeway, text).otherwise(F.concat(cut, F.lit("...")))


def sources_link(description: Column) -> Column:
    """The link in a leading "View all sources" header, else null."""
    return F.nullif(F.regexp_extract(description, SOURCES_HEADER, 1), F.lit(""))


def without_sources_link(description: Column) -> Column:
    return F.regexp_replace(description, SOURCES_HEADER, "")


def with_sources_link(description: Column, url: Column) -> Column:
    """Put the header in front; a null url leaves the text as it is."""
    return F.when(url.isNull(), description).otherwise(
        F.concat(F.lit("View all sources: "), url, F.lit("\n\n---\n\n"), description)
    )


def speech_text(script: Column, limit: int = SPEECH_LIMIT) -> Column:
    return F.left(script, F.lit(limit))
