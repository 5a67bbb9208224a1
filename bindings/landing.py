"""Lay episodes out as files, the way a finished run leaves them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.session import even_parts
from storyline.sources.episodes import AUDIO, SCRIPT, SOURCES_VIEW

#: Batches that landed entries arrive in, about.
BATCHES = 4


def land_episodes(episodes: DataFrame, root: str) -> None:
    """Write ``root/<show>/<date>/<date>-<kind>`` files from the tasks; the audio is a stand-in of the stated size."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for row in batch.itertuples():
                folder = f"{base}/{row.show}/{row.day}"
                files = {SCRIPT: row.script.encode(), AUDIO: bytes(row.audio_bytes)}
                if row.has_sources_view:
                    files[SOURCES_VIEW] = b"<html></html>"
                system.create_dir(folder)
                for kind, content in files.items():
                    with system.open_output_stream(f"{folder}/{row.day}{kind}") as out:
                        out.write(content)
            yield pd.DataFrame({"written": [len(batch)]})

    rows = episodes.select("show", F.date_format("date", "yyyy-MM-dd").alias("day"), "script", "audio_bytes", "has_sources_view")
    rows.mapInPandas(write, "written bigint").agg(F.sum("written")).collect()


def land_entries(entries: DataFrame, path: str, *order: Column) -> int:
    """Write entries as files, in ranges of ``order`` or dealt out by ``seq``; the result is the number of files that make a batch.

    There are as many files as tasks of a shuffle, so that none of them, and no task of a batch, holds a fixed share of all entries.
    """
    files = max(BATCHES, even_parts(entries))
    spread = entries.repartitionByRange(files, *order) if order else entries.repartition(files, "seq")
    spread.write.parquet(path)
    return -(-files // BATCHES)
