from __future__ import annotations

from datetime import date

from bindings.landing import land_episodes
from storyline.plans import catalog
from storyline.session import new_path
from storyline.sources import episodes as P

EPISODE = "show string, date date, script string, audio_bytes bigint, duration_s int, has_sources_view boolean"


def sample(spark):
    rows = [
        ("s", date(2026, 2, 6), "Hello & <welcome>", 7, 61, True),
        ("s", date(2026, 2, 7), "Second\nday", 9, 62, False),
        ("t", date(2026, 2, 7), None, 5, None, False),
    ]
    shows = spark.createDataFrame([("s", "The S", "https://e.org/s"), ("t", "The T", "https://e.org/t")], "show string, name string, base_url string")
    return spark.createDataFrame(rows, EPISODE), shows


def test_episode_folders(spark, tmp_path):
    episodes, _ = sample(spark)
    land_episodes(episodes.filter("script is not null"), str(tmp_path))
    for extra in ("s/drafts/drafts-audio.mp3", "s/2026-02-30/2026-02-30-audio.mp3", "s/2026-02-08/2026-02-08-script.md"):
        path = tmp_path / extra
        path.parent.mkdir(parents=True)
        path.write_text("x")
    times = spark.createDataFrame([("s", date(2026, 2, 6), 61)], "show string, date date, duration_s int")
    found = {r.date.day: r for r in P.read_episodes(spark, str(tmp_path), times).collect()}
    assert sorted(found) == [6, 7]
    assert (found[6].script, found[6].audio_bytes, found[6].has_sources_view, found[6].duration_s) == ("Hello & <welcome>", 7, True, 61)
    assert found[7].script == "Second\nday" and not found[7].has_sources_view and found[7].duration_s is None


def test_episode_files_are_listed_by_tasks(spark, tmp_path):
    """No list of files reaches the driver; marks and empty files do not count, as for Spark's readers."""
    episodes, _ = sample(spark)
    land_episodes(episodes.filter("script is not null"), str(tmp_path))
    for extra, text in (("s/2026-02-09/2026-02-09-audio.mp3", ""), ("s/2026-02-10/_2026-02-10-audio.mp3", "x"), (".t/2026-02-07/2026-02-07-audio.mp3", "x")):
        (tmp_path / extra).parent.mkdir(parents=True)
        (tmp_path / extra).write_text(text)
    found = P.list_files(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.value) for r in found.collect()) == [
        ("2026-02-06-audio.mp3", 7, None), ("2026-02-06-script.md", 17, "Hello & <welcome>"), ("2026-02-06-sources-view.html", 13, None),
        ("2026-02-07-audio.mp3", 9, None), ("2026-02-07-script.md", 10, "Second\nday"),
    ]
    assert "InMemoryFileIndex" not in found._jdf.queryExecution().toString() and not found.inputFiles()
    assert sorted(r.date.day for r in P.read_episodes(spark, str(tmp_path)).collect()) == [6, 7]


def test_feed_there_and_back(spark):
    items = P.episode_items(*sample(spark))
    by_title = {r.title: r for r in items.collect()}
    first = by_title["The S - 2026-02-06"]
    assert first.guid == "https://e.org/s/artifacts/2026-02-06"
    assert first.enclosure["_url"] == first.link == first.guid + "/2026-02-06-audio.mp3"
    assert first.pubDate == "Fri, 06 Feb 2026 08:00:00 +0000"
    assert by_title["The T - 2026-02-07"].description == "Episode for 2026-02-07"
    path = new_path(spark, "feed")
    rows = {(r.show, r.position): r for r in catalog.episode_catalog(items, path).collect()}
    assert [rows["s", i].published for i in (1, 2)] == ["2026-02-07", "2026-02-06"]
    assert rows["s", 2].sources_url == "https://e.org/s/artifacts/2026-02-06/2026-02-06-sources-view.html"
    assert rows["s", 2].description == "Hello & <welcome>" and rows["s", 1].sources_url is None
    assert rows["s", 2].audio_url == first.link
    raw = spark.read.text(path, wholetext=True).collect()
    assert any("<itunes:duration>61</itunes:duration>" in r.value for r in raw)


def test_entries_without_enclosure_or_date(spark, tmp_path):
    folder = tmp_path / "show=s"
    folder.mkdir()
    (folder / "feed.xml").write_text(
        '<rss><channel><item><link rel="enclosure" href="https://e.org/a.mp3">x</link><pubDate>one day</pubDate></item>'
        '<item><title>t</title><enclosure url="https://e.org/p.png" type="image/png"/>'
        '<enclosure url="https://e.org/b.mp3" type="audio/mpeg"/></item></channel></rss>'
    )
    found = {r.title: r for r in P.read_episode_feed(spark, str(tmp_path)).collect()}
    assert (found["Untitled"].audio_url, found["Untitled"].published) == ("https://e.org/a.mp3", "one day")
    assert (found["t"].audio_url, found["t"].description) == ("https://e.org/b.mp3", "")


def test_script_budget(spark):
    df = spark.createDataFrame([("x" * 5000,), ("y" * 5001,)], "script string")
    found = [(len(r.spoken), r.script_length, r.is_cut) for r in catalog.script_budget(df).collect()]
    assert found == [(5000, 5000, False), (5000, 5001, True)]


def test_catalog_reads_its_entries_once(spark):
    """The range shuffle of the positions samples what it reads, which must not be the feed files."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("a", f"t{k}", f"2026-01-{k % 28 + 1:02d}", "one two") for k in range(60)]
    entries = spark.createDataFrame(rows, "show string, title string, published string, description string")
    found = catalog.catalog_rows(entries.mapInArrow(counted, entries.schema)).collect()
    assert read.value == 60
    assert [r.title for r in sorted(found, key=lambda r: r.position)] == [t for _, t, p, _ in sorted(rows, key=lambda r: (-int(r[2][-2:]), r[1]))]
