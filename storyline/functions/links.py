"""Link and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names looked for in a file name, the marker before a custom one, and the default.
MODEL_NAMES = ["voyage", "openai"]
MODEL_MARKER = "-with-embeddings-"
DEFAULT_MODEL = "openai"


def extract_domain(url: Column) -> Column:
    """Network location without one leading ``www.``; port, user and case stay; "" when there is none."""
    location = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    broken = location.contains("[") != location.contains("]")
    return F.when(broken, F.lit("")).otherwise(F.regexp_replace(location, r"^www\.", ""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def model_name(path: Column) -> Column:
    """The embedding model a file name tells."""
    stem = F.lower(file_stem(path))
    found = F.when(stem.contains(MODEL_NAMES[0]), MODEL_NAMES[0])
    for name in MODEL_NAMES[1:]:
        found = found.when(stem.contains(name), name)
    place = F.locate(MODEL_MARKER, stem)
    return found.when(place > 0, F.substr(stem, place + len(MODEL_MARKER))).otherwise(DEFAULT_MODEL)


def issue_of_file(path: Column) -> Column:
    """The date at the start of a file name."""
    return F.left(file_stem(path), F.lit(10))
