from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from storyline.functions import dates as D
from storyline.functions import links as L
from storyline.functions import text as X
from storyline.functions import vectors as V


def test_clean_html(column):
    given = ["&lt;b&gt;x&lt;/b&gt;", "a<br>b", "&amp;lt;", "a&nbsp;b", "  a \n\t b c ", None, "", "caf&eacute; &#8364; &amp;", "a &copy b", "x\x1cy", "&amp;amp;"]
    expected = ["x", "ab", "&lt;", "a b", "a b c", "", "", "café € &", "a © b", "x y", "&amp;"]
    assert column(X.clean_html, given) == expected


def test_clean_author(column):
    given = ["a@b.it (Mario Rossi)", "Di Anna", "di  Anna", "diana", None, "a@b.it (Di Anna)", "<b>Ugo</b>"]
    assert column(X.clean_author, given) == ["Mario Rossi", "Anna", "Anna", "diana", "", "Anna", "Ugo"]


def test_feed_suffix(column):
    titles = ["Title - Il Post", "Title -Il Post", "Title", "A - - Il Post", "Il Post", "- Il Post", "Titolo Il Post"]
    names = ["Il Post"] * len(titles)
    assert column(X.strip_name_from_title, titles, names) == ["Title", "Title", "Title", "A -", "Il Post", "", "Titolo Il Post"]
    texts = ["Some text Il Post", "Some textIl Post", "Il Post"]
    assert column(X.strip_name_from_description, texts, ["Il Post"] * 3) == ["Some text", "Some textIl Post", "Il Post"]


def test_feed_patterns(column):
    pattern = r"^AGI\s*-\s*"
    assert column(X.strip_prefix_pattern, ["AGI - News", "News AGI - x", "AGI News"], [pattern] * 3) == ["News", "News AGI - x", "AGI News"]
    assert column(X.strip_suffix_pattern, ["a [x]", "[x] a"], [r"\s\[x\]"] * 2) == ["a", "[x] a"]
    assert column(X.strip_prefix_pattern, ["è vero"], [r"\w "]) == ["vero"]
    assert column(X.strip_prefix_pattern, ["AGI - x"], [None]) == ["AGI - x"]


def test_useless_descriptions(column):
    rule = lambda d, t: X.blank_useless(d, t, X.CleaningRules())
    given = ["undefined", "Read more", "x" * 14, "x" * 15, "the TITLE — of | it now", "Read More at length"]
    titles = ["t"] * 4 + ["The title of it – now", "t"]
    assert column(rule, given, titles) == ["", "", "", "x" * 15, "", "Read More at length"]


def test_embedding_text(column):
    assert column(X.embedding_text, ["T", "T", " T ", "T"], ["d", "", "nan", None]) == ["T. d", "T", "T", "T"]


def test_preview_and_truncate(column):
    assert column(X.preview, ["x" * 180, "x" * 181]) == ["x" * 180, "x" * 180 + "..."]
    words = "word " * 101
    given = [words[:505], words[:505] + "d", "y" * 506]
    assert column(X.truncate_words, given) == [words[:505], words[:494] + "...", "y" * 497 + "..."]


def test_sources_link(column):
    text = "View all sources: https://e.org/x\n\n---\n\nHello"
    assert column(X.sources_link, [text, "Hello"]) == ["https://e.org/x", None]
    assert column(X.without_sources_link, [text, "Hello"]) == ["Hello", "Hello"]
    assert column(X.with_sources_link, ["Hello", "Hello"], ["https://e.org/x", None]) == [text, "Hello"]


def test_dates(column):
    good = datetime(2026, 2, 7, 18, 45, 6)
    cases = {
        "Sat, 07 Feb 2026 18:45:06 GMT": (good, False),
        "Sat, 07 Feb 2026 18:45:06 Z": (good, True),
        "Sat, 07 Feb 2026 19:45:06 +0100": (good, True),
        "Sat, 7 Feb 2026 18:45:06 +0000": (good, True),
        "7 Feb 2026 18:45:06": (good, False),
        "2026-02-07T18:45:06Z": (good, True),
        "2026-02-07T19:45:06.123+01:00": (good.replace(microsecond=123000), True),
        "2026-02-07 18:45:06": (good, True),
        "07/02/2026 18:45": (good.replace(second=0), True),
        "Sun, 08 Feb 2026 00:15:06 +0530": (good, True),
        "Sat, 07 Feb 2026 13:45:06 -0500": (good, True),
        "soon": (None, False),
        "": (None, False),
        "Sat, 32 Feb 2026 18:45:06 GMT": (None, False),
        "2026-13-45T00:00:00Z": (None, False),
    }
    texts = list(cases)
    shown = lambda c: F.date_format(D.parse_published(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    strict = lambda c: D.view_published(c, strict_view=True).isNotNull()
    expected = [None if t is None else t.strftime("%Y-%m-%d %H:%M:%S.%f") for t, _ in cases.values()]
    assert column(shown, texts) == expected
    assert column(strict, texts) == [s for _, s in cases.values()]
    wall = lambda c: F.date_format(D.wall_clock(c), "dd HH:mm")
    assert column(wall, texts)[2] == "07 19:45"
    assert column(D.catalog_date, ["Sun, 08 Feb 2026 00:15:06 +0530", "soon"]) == ["2026-02-07", "soon"]


def test_time_display(column):
    issue = lambda c: D.time_display(D.wall_clock(c), F.to_date(F.lit("2026-02-07")))
    given = ["Sat, 07 Feb 2026 19:45:06 +0100", "Fri, 06 Feb 2026 09:05:00 +0100", None]
    assert column(issue, given) == ["19:45", "06 Feb 09:05", ""]
    italian = lambda c: D.italian_datetime(D.wall_clock(c).cast("timestamp"))
    assert column(italian, ["2026-01-21 18:45:00"]) == ["Mercoledì 21 Gennaio 18:45"]


def test_domains(column):
    given = ["https://www.a.it:80/x", "http://u@A.it/", "notaurl", None, "//b.it/x", "https://www.www.c.it?q", "http://[::1/x"]
    assert column(L.extract_domain, given) == ["a.it:80", "u@A.it", "", "", "b.it", "www.c.it", ""]


def test_model_names(column):
    given = ["/d/2026-02-05-sources-with-embeddings-voyage.parquet", "/d/2026-02-05-with-embeddings.parquet", "/d/x-with-embeddings-mine.parquet"]
    assert column(L.model_name, given) == ["voyage", "openai", "mine"]
    assert column(L.issue_of_file, given[:1]) == ["2026-02-05"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<double>")
    row = df.select(V.l2_normalize(F.col("a")).alias("u"), V.cosine_distance(F.col("a").cast("array<double>"), F.col("b")).alias("d")).collect()
    assert [round(x, 9) for x in row[0].u] == [0.6, 0.8] and row[0].d == 1.0
    assert row[1].u == [0.0, 0.0] and row[1].d == 1.0


def test_dates_keep_day_of_issue(spark):
    rows = spark.createDataFrame([(date(2025, 12, 9),)], "date date").select(D.mail_date(D.publication_time(F.col("date"))))
    assert rows.first()[0] == "Tue, 09 Dec 2025 08:00:00 +0000"


def test_more_date_shapes(column):
    shapes = {
        "Sat, 07 Feb 2026 18:45:06 EST": "2026-02-07 18:45:06",
        "Sat, 07 February 2026 18:45:06 +0100": "2026-02-07 17:45:06",
        "07 Feb 26 18:45 CET": "2026-02-07 18:45:00",
        "Feb 7, 2026 10:00": "2026-02-07 10:00:00",
        "Sat Feb 7 18:45:06 2026": "2026-02-07 18:45:06",
        "2026/02/07": "2026-02-07 00:00:00",
        "Feb 7, 2026 10:00 PM": "2026-02-07 22:00:00",
        "7 Feb 2026 12:05 a.m.": "2026-02-07 00:05:00",
        "20260207T184506Z": "2026-02-07 18:45:06",
        "Sat, 31 Feb 2026 10:00:00 GMT": None,
        "2026": None,
        "a|b": None,
    }
    found = column(lambda c: D.parse_published(c).cast("string"), list(shapes))
    assert found == list(shapes.values())


def test_dates_of_every_signature(column):
    shapes = {
        "20260207": "2026-02-07 00:00:00",
        "20260207T184506Z": "2026-02-07 18:45:06",
        "2026-02-07T18:45:06+01": "2026-02-07 17:45:06",
        "Sat, 07 Feb 2026 18:45:06 GMT+2": "2026-02-07 20:45:06",
        "2026-02-07 10:00 UTC+3": "2026-02-07 13:00:00",
        "03/02/2026": "2026-02-03 00:00:00",
        "7/2/26": "2026-02-07 00:00:00",
        "2026.02.07 10:00": "2026-02-07 10:00:00",
        "07.02.2026 10:00": "2026-02-07 10:00:00",
        "07-02-2026 10:00": "2026-02-07 10:00:00",
        "10:00 Feb 7 2026": "2026-02-07 10:00:00",
        "10:00 7 Feb 2026": "2026-02-07 10:00:00",
        "Saturday, February 7, 2026 at 10:00 AM": "2026-02-07 10:00:00",
        "Saturday, February 7, 2026 at 10:00 pm": "2026-02-07 22:00:00",
        "Feb 7 2026": "2026-02-07 00:00:00",
        "Sat Feb  7 18:45:06 2026": "2026-02-07 18:45:06",
        "2026-02-30": None,
        "31.02.2026": None,
        "2026-02-07T25:00:00Z": None,
        "12345678901": None,
        "soon 7 2026": None,
        "": None,
        None: None,
    }
    assert column(lambda c: D.parse_published(c).cast("string"), list(shapes)) == list(shapes.values())
