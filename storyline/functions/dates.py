"""Feed dates: instants, wall clocks and display forms.

A feed date is recognised by its signature first and rewritten and parsed once, so no row raises and retries. The offset in the
text gives the instant; the clock before it is kept apart for display.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day and month names of the display form.
ITALIAN_DAYS = ["Lunedì", "Martedì", "Mercoledì", "Giovedì", "Venerdì", "Sabato", "Domenica"]
ITALIAN_MONTHS = [
    "Gennaio", "Febbraio", "Marzo", "Aprile", "Maggio", "Giugno",
    "Luglio", "Agosto", "Settembre", "Ottobre", "Novembre", "Dicembre",
]
PUBLISH_HOUR = 8

# Month names by their first letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# A zone's name doesn't move the clock: it counts as UTC.
DAY_NAME = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
MONTH = r"((?i:" + "|".join(MONTHS) + r"))[a-z]{0,6}\.?"
CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)(?:\s*([AaPp])\.?[Mm]\.?)?"
ZONE = r"(?:\s*(?:[A-Z]{1,5}|(?:[A-Z]{3,5})?[+-]\d{1,2}(?::?\d{2})?))?"
THEN = r"(?:,?[ T]+(?:at\s+)?)"

#: Signatures (digits as 9, words as A) and the one rewrite each needs: the shape, then the groups of year, month, day, clock and
#: half of the day; 0 stands for a group the shape doesn't have. A text is rewritten by the first signature it begins with.
SHAPES = [
    (r"9{4}[-/.]9", rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:{THEN}{CLOCK}{ZONE})?", (1, 2, 3, 4, 5)),
    (r"(?:A\.?,? +)?9{1,2}[ -]+A", rf"{DAY_NAME}(\d{{1,2}})[ -]+{MONTH}[ ,-]+(\d{{4}}|\d{{2}})(?:{THEN}{CLOCK}{ZONE})?", (3, 2, 1, 4, 5)),
    (r"(?:A\.?,? +)?A\.? +9{1,2} +9{1,2}:", rf"{DAY_NAME}{MONTH}\s+(\d{{1,2}})\s+{CLOCK}{ZONE}\s+(\d{{4}})", (5, 1, 2, 3, 4)),
    (r"(?:A\.?,? +)?A\.? +9{1,2}[ ,]", rf"{DAY_NAME}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:{THEN}{CLOCK}{ZONE})?", (3, 1, 2, 4, 5)),
    (r"9{1,2}[/.-]9{1,2}[/.-]9", rf"(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:{THEN}{CLOCK}{ZONE})?", (3, 2, 1, 4, 5)),
    (r"9{8}A?9{0,6}", rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(\d{{2}})?{ZONE})?", None),
    (r"9{1,2}:.* A\.? +9{1,2},? +9{4}", rf"{CLOCK},?\s+{DAY_NAME}{MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})", (5, 3, 4, 1, 2)),
    (r"9{1,2}:.* 9{1,2} +A\.?,? +9{4}", rf"{CLOCK},?\s+{DAY_NAME}(\d{{1,2}})\s+{MONTH},?\s+(\d{{4}})", (5, 4, 3, 1, 2)),
]
COMPACT = "$1|$2|$3|$4:$5:$6|"
OFFSET_TAIL = r"^.*(?:T\d{4,6}|:\d{2}(?:\.\d+)?)(?:\s*[AaPp]\.?[Mm]\.?)?\s*([A-Z]{3,5})?([+-])(\d{1,2})(?::?([0-5]\d))?(?: \d{4})?$"


def signature(text: Column) -> Column:
    """The shape of a text: digits as 9, each run of letters as A."""
    return F.regexp_replace(F.translate(text, "0123456789", "9" * 10), "[A-Za-z]+", "A")


def wall_clock(text: Column) -> Column:
    """The clock written in the text, without its offset, as a zone-less timestamp; null if unreadable.

    Dates of digits are read day first unless the year stands first. A two-digit year is of this century. The signature of the text
    picks the one shape that can match; that rewrites it as ``year|month|day|clock|half``.
    """
    plain = F.trim(text)
    # Each step is an array of one, so that what it made is used many times and computed once.
    marked = F.array(F.struct(plain.alias("text"), signature(plain).alias("shape")))
    split = F.transform(marked, lambda m: F.split(_rewritten(m["text"], m["shape"]), r"\|"))
    return F.transform(split, _clock_of)[0]


def _rewritten(text: Column, shape: Column) -> Column:
    found = F
    for mark, pattern, groups in SHAPES:
        made = F.regexp_replace(text, f"^{pattern}$", COMPACT if groups is None else "|".join(f"${g}" for g in groups))
        found = found.when(shape.rlike(f"^{mark}"), made)
    return found


def _clock_of(parts: Column) -> Column:
    """The timestamp of ``[year, month, day, clock, half]``; null for another number of parts."""
    part = lambda k: F.try_element_at(parts, F.lit(k))
    named = F.position(F.lower(part(2)), F.lit("".join(MONTHS)))
    month = F.when(part(2).rlike("^[0-9]+$"), part(2)).otherwise(((named + 2) / 3).cast("int").cast("string"))
    year = F.when(F.length(part(1)) == 2, F.concat(F.lit("20"), part(1))).otherwise(part(1))
    whole = F.trim(F.concat_ws(" ", F.concat_ws("-", year, month, part(3)), F.rtrim(part(4), F.lit(":"))))
    halved = F.try_to_timestamp(F.concat(whole, F.lit(" "), F.upper(part(5)), F.lit("M")), F.lit("yyyy-M-d h:mm[:ss] a")).cast("timestamp_ntz")
    read = F.when(part(5) != "", halved).otherwise(whole.try_cast("timestamp_ntz"))
    return F.when(F.size(parts) == 5, read)


def parse_published(text: Column) -> Column:
    """The instant of a feed date; no zone, ``Z`` and ``GMT`` are UTC; null if unreadable. The session is in UTC.

    An offset behind a zone's name tells what to add to reach that zone, so its sign counts the other way.
    """
    offset = F.transform(F.array(F.trim(text)), _offset_of)[0]
    return F.convert_timezone(offset, F.lit("UTC"), wall_clock(text)).cast("timestamp")


def _offset_of(text: Column) -> Column:
    found = F.split(F.regexp_replace(text, OFFSET_TAIL, "$1|$2|$3|$4"), r"\|")
    sign = F.when(found[0] == "", found[1]).otherwise(F.translate(found[1], "+-", "-+"))
    minutes = F.when(found[3] == "", "00").otherwise(found[3])
    given = F.concat(sign, F.lpad(found[2], 2, "0"), F.lit(":"), minutes)
    return F.when(text.rlike(OFFSET_TAIL) & (F.lpad(found[2], 2, "0") <= "17"), given).otherwise("+00:00")


# The shapes the display parser takes.
OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})"
VIEW_SHAPES = [
    r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{1,2}:\d{1,2} " + OFFSET + "$",
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?" + OFFSET + "$",
    r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$",
]


def view_published(text: Column, strict_view: bool = False) -> Column:
    """The instant used by the views; ``strict_view`` takes the display shapes only, so ``GMT`` dates are null."""
    if not strict_view:
        return parse_published(text)
    return F.when(F.trim(text).rlike("|".join(VIEW_SHAPES)), parse_published(text))


def time_display(wall: Column, issue_date: Column) -> Column:
    """``HH:MM`` on the issue's own day, else ``DD Mon HH:MM``; "" without a date."""
    return F.coalesce(
        F.when(wall.cast("date") == issue_date, F.date_format(wall, "HH:mm")).otherwise(
            F.date_format(wall, "dd MMM HH:mm")
        ),
        F.lit(""),
    )


def italian_datetime(stamp: Column) -> Column:
    """``Lunedì 21 Gennaio 18:45``."""
    day = F.element_at(F.array(*map(F.lit, ITALIAN_DAYS)), F.weekday(stamp) + 1)
    month = F.element_at(F.array(*map(F.lit, ITALIAN_MONTHS)), F.month(stamp))
    return F.concat_ws(" ", day, F.dayofmonth(stamp).cast("string"), month, F.date_format(stamp, "HH:mm"))


def publication_time(date: Column) -> Column:
    """An episode is published at 08:00 UTC of its day."""
    return F.make_timestamp(
        F.year(date), F.month(date), F.dayofmonth(date), F.lit(PUBLISH_HOUR), F.lit(0), F.lit(0), F.lit("UTC")
    )


def mail_date(stamp: Column) -> Column:
    """RFC 822 form of a UTC instant."""
    return F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss Z")


def catalog_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of a feed date, or the raw text when unreadable."""
    return F.coalesce(F.date_format(parse_published(text), "yyyy-MM-dd"), text)
